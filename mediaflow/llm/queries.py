"""The registered queries of this subpackage, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.llm import (
    attribution,
    binary,
    boilerplate,
    chat,
    divergence,
    imatch,
    language,
    lines,
    minhash,
    mixing,
    negatives,
    repeats,
    winnow,
)
from mediaflow.llm.common import read, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


MIX_SQL = r"""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
twins as (select *, row_number() over (partition by doc_id order by source nulls first, size) as twin from sized),
sources as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from sized group by source),
shares as (
  select *, 3 * source_size as most,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over (
            order by 3 * source_size / weight, source nulls last
            rows between unbounded preceding and 1 preceding), 0))::double
         / sum(weight) over (order by 3 * source_size / weight, source nulls last
            rows between current row and unbounded following) as share
  from sources),
targets as (
  select source, source_size,
         least(most::double, coalesce(max(case when most >= share * weight then share end) over () * weight, most::double)) as target
  from shares),
copies as (
  select t.*, s.source_size, s.target, e.epoch, md5('7:' || e.epoch || ':' || coalesce(t.doc_id::varchar, '') || ':' || t.twin) as digest
  from twins t join targets s on t.source is not distinct from s.source
  join (select unnest([0, 1, 2]) as epoch) e
    on e.epoch < case when s.source_size > 0 then least(floor(s.target / s.source_size) + 1, 3) else 1 end),
finished as (
  select *, case when target > 0 then (epoch * source_size + sum(size) over (
      partition by source, epoch order by digest, doc_id nulls first, twin
      rows between unbounded preceding and current row))::double / target else 0 end as finish
  from copies),
placed as (
  select *, sum(size) over (order by finish, source nulls last, epoch, digest, doc_id nulls first, twin
      rows between unbounded preceding and current row) <= (select sum(size) from sized) as taken
  from finished)
select doc_id, size, source_size, target, sum(case when taken then size else 0 end)::bigint as taken
from placed group by doc_id, twin, source, size, source_size, target
"""


@query("op2_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    copies = mixing.mixed(read(spark, folder, "documents"), "doc_id", "source", mixing.words(F.col("text")))
    return copies.groupBy(F.col("id").alias("doc_id"), "twin", "source", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")
    ).select("doc_id", "size", "source_size", "target", "taken")


CHAT_SQL = r"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
clean as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from turns),
written as (
  select *, replace(replace(replace(text, '\', '\\'), '##', '\h#'), '</turn>', '\l/turn>') as body,
         replace(replace(replace(replace(role, '\', '\\'), '##', '\h#'), '</turn>', '\l/turn>'), ':', '\c') as mark,
         lag(role) over (partition by conv_id order by turn nulls first, role, text) as before
  from clean)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
       sum(length(body) + 7 + case when before is null or before <> role then length(mark) + 6 else 0 end)::bigint as formatted_chars
from written group by conv_id
"""


@query("op9_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    out = chat.formatted(turns.unionByName(extra)).withColumn("turns", chat.parsed(F.col("formatted")))
    loss = F.array_join(
        F.transform(
            F.filter(F.arrays_zip("turns", "loss_mask"), lambda t: t["loss_mask"]), lambda t: t["turns"]["text"]
        ),
        "",
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Fixed value: ids of that vocabulary.
VOCABULARY = 50_257


@query("op4_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    # Without a separator, tokens do cross the seams between the fields.
    counts = attribution.attributed(documents, "doc_id", ["source", "lang", "text"], tokenizer_path(), separator="")
    return counts.withColumnRenamed("id", "doc_id")


@query("op7_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    binary.write_tokens(read(spark, folder, "documents"), path, tokenizer_path(), VOCABULARY, "doc_id", "text")
    return binary.read_tokens(spark, path)


@query("op3_language")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = language.learned(documents.filter(~language.held_out("doc_id")), "text", "lang")
    return language.identified(documents.select("doc_id", "text"), "text", profiles).select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


WINNOW_SQL = r"""
with words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
items as (
  select item_id, w, least(len(w), 10) as width
  from (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark) where len(w) > 0),
item_windows as (
  select distinct item_id, width, array_to_string(w[i:i + width - 1], ' ') as win
  from (select *, unnest(range(1, len(w) - width + 2)) as i from items)),
widths as (select distinct width from items),
doc_windows as (
  select doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') as win
  from (select doc_id, w, width, unnest(range(1, len(w) - width + 2)) as i from words, widths)),
hits as (select doc_id, d.width, i, item_id from doc_windows d join item_windows t on d.width = t.width and d.win = t.win),
hit_words as (select doc_id, count(distinct i + k)::bigint as n_hit
  from (select doc_id, i, unnest(range(0, width)) as k from hits) group by doc_id),
hit_items as (select doc_id, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct doc_id, item_id from hits) group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


@query("op6_decontaminate", WINNOW_SQL)
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    found = winnow.searched(documents, read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        winnow.covered_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


SHINGLE_SQL = r"""
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, w[i] || ' ' || w[i + 1] as s from (select *, unnest(range(1, len(w))) as i from words)
    union all select doc_id, w[1] from words where len(w) = 1)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id),
links as (
  select a, b from common c join sizes x on c.a = x.doc_id join sizes y on c.b = y.doc_id
  where 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach(doc_id, other) as (
  select doc_id, doc_id from words
  union select r.doc_id, l.b from reach r join links l on r.other = l.a)
select w.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id, w.doc_id = min(other) as kept
from words w join reach r using (doc_id) left join sizes using (doc_id) group by w.doc_id
"""


@query("op8_near_duplicates", SHINGLE_SQL)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"), width=2)


@query("op10_fingerprints")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    in_band = imatch.band(documents, "text")
    pairs = imatch.edited_pairs(documents, "doc_id", "text", in_band)
    return pairs.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        imatch.as_text(F.col("print")).alias("fingerprint"),
        imatch.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        imatch.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        imatch.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


@query("op1_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return boilerplate.main_text(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))


@query("op5_repeats")
def repeats_removed(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = repeats.without_repeats(read(spark, folder, "documents"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


DIVERGENCE_SQL = r"""
with texts as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
found as (select r, lang, source, unnest(w) as term from texts),
kept as (select lang, term, count(*) as total from found group by lang, term having count(distinct r) >= 3),
counts as (select lang, source, term, count(*) as n from found semi join kept using (lang, term) group by lang, source, term),
languages as (select lang, count(*) as v, sum(total)::bigint as lang_size from kept group by lang),
sizes as (
  select g.lang, g.source, coalesce(sum(n), 0)::bigint as size
  from (select distinct lang, source from texts) g left join counts c on g.lang = c.lang and g.source = c.source
  group by g.lang, g.source),
shares as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
         1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.size + l.v) as p,
         1 + 1000000000 * (k.total + 1) // (l.lang_size + l.v) as q
  from sizes s join languages l on s.lang = l.lang join kept k on s.lang = k.lang
  left join counts c on s.lang = c.lang and s.source = c.source and k.term = c.term),
sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
  from sizes a join sizes b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, (p - q) * (p - q) // q as value from shares where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
       row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (
  select lang, source, 'term' as part, item, value,
         row_number() over (partition by lang, source order by value desc, item)::int as rank from terms)
where rank <= 200
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audited(read(spark, folder, "documents"))


LINES_SQL = r"""
with pieces as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
placed as (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i, row_number() over () as r from pieces),
keyed as (
  select doc_id, r, i, lines[i] as line,
         translate(trim(lines[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from placed),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3)
select doc_id, count(*)::bigint as n_lines, count(keeper)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where keeper is null), '')) as kept_sha256
from keyed left join common on keyed.key = common.key and keyed.doc_id <> common.keeper
group by doc_id
"""


@query("op12_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    cleaned = lines.without_lines(documents, lines.keep_bitmaps(documents))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


NEGATIVES_SQL = r"""
with usable as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_dot_product(a.v, b.v)::bigint as score
  from usable a join usable b on a.vec_id % 100 = 0),
positives as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score
  from scored where label = anchor_label and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> p.anchor_label
  and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=shifted)
