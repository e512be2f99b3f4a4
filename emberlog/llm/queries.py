"""The corpus operators over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import (
    automaton_dedup,
    conversation_repair,
    decontaminate,
    html_extract,
    mixing,
    ngram_join,
    packing,
    quality,
    spelling,
    suffix_dedup,
    token_files,
    tokens,
    url_filter,
    winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str):
    """Registers a query."""

    def add(function):
        QUERIES[name] = function
        return function

    return add


URL_RULES = (
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
)


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with ``bad``: the label of the document whose number the path names (as in ``/en/25``)."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).cast("boolean").alias("bad")
    )
    number = F.try_to_number(F.regexp_extract("url", "://[^/?#]*/[a-z]+/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("_number", number)
    return pages.join(labels, pages["_number"] == labels["doc_id"], "left").select("page_id", "url", "bad")


@query("op1_winnowing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_report(table(spark, sf_dir, "documents"))


@query("op3_cutting_stock")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokens.public_tokenizer("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, end_id=1)


@query("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query("op6_automaton_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.report(table(spark, sf_dir, "documents"))


@query("op9_ngram_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokens.public_tokenizer("byte_bpe_50k.json")
    folder = token_files.shared_uri(spark, "token-files")
    manifest = token_files.write_files(table(spark, sf_dir, "documents"), tokenizer, 0, folder)
    return token_files.read_files(manifest)


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(labelled_pages(spark, sf_dir), URL_RULES)


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).drop("source")


@query("op8_quality_bands")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.with_typos(spelling.runs(table(spark, sf_dir, "documents")))
    return spelling.variants(spelling.vocabulary(found))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query("op13_decontamination")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# --- SQL ---------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op6_automaton_dedup"] = rf"""with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 34], ' ') as s
    from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
rep as (select doc_id, i from win where s in (select s from win group by s having count(*) > 1)),
cov as (select distinct doc_id, i + k as pos from rep, (select unnest(range(35)) as k)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
kept as (select doc_id, string_agg(word, ' ' order by pos) as t from words anti join cov using (doc_id, pos)
    group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join (select doc_id, count(*) as n from cov group by doc_id) using (doc_id) left join kept using (doc_id)"""

ORACLE["op7_mixing"] = rf"""with d as (select doc_id, source, cast(len({_WORDS}) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as s from documents),
src as (select source, cast(sum(size) as bigint) as source_size from d group by source),
weighed as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight,
    3 * source_size::double as cap from src),
filling as (select *, sum(source_size) over () - coalesce(sum(cap) over before, 0) as rest,
        sum(weight) over () - coalesce(sum(weight) over before, 0) as open from weighed
    window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
goal as (select source, source_size, least(cap, weight * max(case when cap * open >= weight * rest
    then rest / open end) over ()) as target from filling),
queued as (select d.*, source_size, target, coalesce(sum(size) over (partition by d.source order by s, doc_id
        rows between unbounded preceding and 1 preceding), 0) as given
    from d join goal on d.source is not distinct from goal.source)
select doc_id, size, source_size, target,
    cast(sum(greatest(0, least(size, floor(target) - e * source_size - given))) as bigint) as taken
from queued, (select unnest(range(3)) as e) group by all"""

_LOWERED = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"

ORACLE["op9_ngram_join"] = rf"""with recursive d as (
    select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, s from (
    select doc_id, array_to_string(w[i : i + 3], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from d)
    union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 3)),
sizes as (select doc_id, count(*) as n from sh group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
    where 100 * c >= 85 * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as c from d union select y, c from reach join edges on x = doc_id)
select doc_id, coalesce(n, 0) as n_shingles, min(c) as component_id
from reach left join sizes using (doc_id) group by doc_id, n"""

_TOKENS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op13_decontamination"] = rf"""with d as (select doc_id, {_TOKENS} as w from documents),
item as (select cast(item_id as varchar) as item, {_TOKENS} as w from benchmark),
win as (select distinct item, w[i : i + 9] as s from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i
    from item where len(w) > 0)),
sizes as (select distinct len(s) as k from win),
place as (select doc_id, k, i, w[i : i + k - 1] as s
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes)),
hit as (select doc_id, k, i, s from place where s in (select s from win)),
n as (select doc_id, count(distinct i + j) as n_hit from (select doc_id, i, unnest(range(k)) as j from hit)
    group by doc_id),
which as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
    from (select distinct doc_id, item from hit join win using (s)) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join which using (doc_id)"""

# The bytes of a string of characters below U+0800, and crc32 of them, bit by bit.
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] " \
    "else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end))"
_CRC32 = "xor(4294967295, list_reduce(list_concat([4294967295], {0}), lambda a, b: list_reduce(list_concat(" \
    "[xor(a, b)], list_transform(range(8), lambda z: 0::bigint)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"


def _crc32(text: str) -> str:
    return _CRC32.format(f"list_transform({_BYTES.format(text)}, lambda u: u::bigint)")


ORACLE["op12_conversation_repair"] = rf"""with recursive coded as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_crc32("concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' '))")} % 20 as c
    from conversations),
rows as (select conv_id, turn, case when c = 4 then 'user' else role end as role,
        case c when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(range(case c when 0 then 0 when 3 then 2 else 1 end)) as copy from coded),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k,
        right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) as final from rows),
judged as (select *, case when final = '' then 'b' when row_number() over (partition by conv_id, role, text order by k) > 1
            then 'd' when final not in ('.', '!', '?') then 't' else '' end as fault,
        left(role, 1) as c, lead(left(role, 1)) over (partition by conv_id order by k) as after from placed),
ways(st, n, mid, lines) as (values (0, 0, 0, null), (0, 1, 2, 'user:'), (0, 2, 3, 'user:
assistant:'), (1, 0, 1, null), (1, 1, 2, 'user:'), (1, 2, 3, 'user:
assistant:'), (2, 0, 2, null), (2, 1, 3, 'assistant:'), (3, 0, 3, null), (3, 1, 2, 'user:')),
edits(letter, price, mid, st, c, name) as (values ('D', 3, 0, 0, null, null), ('D', 3, 1, 1, null, null),
    ('D', 3, 2, 2, null, null), ('D', 3, 3, 3, null, null), ('K', 0, 0, 1, 's', null), ('K', 0, 0, 2, 'u', null),
    ('K', 0, 1, 2, 'u', null), ('K', 0, 3, 2, 'u', null), ('K', 0, 2, 3, 'a', null), ('R', 2, 0, 2, null, 'user'),
    ('R', 2, 1, 2, null, 'user'), ('R', 2, 3, 2, null, 'user'), ('R', 2, 2, 3, null, 'assistant')),
steps as (
    select distinct conv_id, 0::bigint as k, 0 as st, 0 as cost, '' as audit, null::varchar as lines from coded
    union all
    select conv_id, k, st, cost, audit, lines from (
        select s.conv_id, j.k, e.st, s.cost + 2 * w.n + e.price + case when e.letter <> 'D' and fault = 't' then 1 else 0 end as cost,
            s.audit || repeat('I', w.n) || e.letter as audit,
            case when e.letter = 'D' then nullif(concat_ws(chr(10), s.lines, w.lines), '')
                else concat_ws(chr(10), s.lines, w.lines, coalesce(e.name, j.role) || ':' || j.text) end as lines
        from steps s join judged j on j.conv_id is not distinct from s.conv_id and j.k = s.k + 1
            join ways w on w.st = s.st join edits e on e.mid = w.mid
        where (e.letter = 'D' or fault not in ('b', 'd')) and (e.c is null or e.c = j.c))
    qualify row_number() over (partition by conv_id, st order by cost, audit) = 1),
ends as (select conv_id, cost + 2 * n as cost, audit || repeat('I', n) as audit,
        nullif(concat_ws(chr(10), s.lines, w.lines), '') as lines
    from steps s join ways w on w.st = s.st
    where k = (select count(*) from rows r where r.conv_id is not distinct from s.conv_id) and (mid = 3 or (s.st = 0 and n = 0))
    qualify row_number() over (partition by conv_id order by cost + 2 * n, audit || repeat('I', n)) = 1),
counts as (select conv_id, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
        count(*) filter (fault = 't') as truncated,
        count(*) filter (after is not null and concat(c, after) not in ('su', 'ua', 'au')) as illegal,
        coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from judged group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(cost as bigint) as cost, audit,
    sha256(coalesce(lines, '')) as repaired_sha256
from ends e left join counts n on n.conv_id is not distinct from e.conv_id"""

ORACLE["op11_spelling_variants"] = rf"""with recursive run as (select cast(doc_id as varchar) as doc,
        unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) as r from documents),
seen as (select doc, r, count(*) as times from run where length(r) >= 7 group by all),
coded as (select r, times, {_crc32("concat(doc, ':', r)")} as h from seen),
edited as (select times, case when h % 31 = 0
        then left(r, cast(h % length(r) as int)) || substr(r, cast(h % length(r) as int) + 2) else r end as word from coded),
w as (select word, cast(sum(times) as bigint) as n from edited where length(word) >= 7 group by word having sum(times) >= 2),
cut as (select distinct word, n, left(word, i) || m || substr(word, i + 2) as c, m
    from (select word, n, unnest(range(length(word))) as i from w), (select unnest(['', '*']) as m)),
pair as (select a.word as x, b.word as y, b.n from cut a join cut b using (c) where a.m = '*' and b.m = '*' and a.word <> b.word
    union select c.word, w.word, w.n from cut c join w on c.c = w.word and m = ''
    union select w.word, c.word, c.n from cut c join w on c.c = w.word and m = ''),
best as (select x as word, count(*) as n_near, arg_min(y, (-pair.n, y)) as y, max(pair.n) as y_n from pair group by x),
near as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when y_n >= 10 * w.n then y end as form,
    case when y_n >= 10 * w.n then y_n end as form_n from w left join best using (word)),
chain as (select word, word as goal from near union select chain.word, near.form from chain join near on near.word = goal
    where near.form is not null)
select near.word, near.form, root.goal as root, near.n, n_near, form_n
from near join (select chain.word, goal from chain join near on near.word = goal where near.form is null) root using (word)"""
