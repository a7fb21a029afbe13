"""One query per operator over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import (
    decontaminate,
    exact_dedup,
    fill_middle,
    html_text,
    importance,
    licenses,
    mixing,
    ngram_join,
    ppm,
    sharding,
    suffix_dedup,
    toxicity,
    warc,
)
from sluiceway.sources import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into one index, the larger ids first, so that the largest id of a text stays."""
    docs = table(spark, sf_dir, "documents")
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    middle = ((ends.lo or 0) + (ends.hi or 0)) // 2
    index = exact_dedup.DigestIndex.create(spark)
    newer = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    batches = []
    for part in (docs.filter(newer), docs.filter(~newer)):
        batches.append(exact_dedup.digests(part))
        index.add(batches[-1])
    return exact_dedup.decide(batches, index).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SHARDS = 40


@query()
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_slots(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = (
    {"web": 0.4, "news": 0.25, "books": 0.2, "forum": 0.15},
    {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    None,
)


def domain_column() -> dict[str, Column]:
    """Sources play web sites: their number decides the domain."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    domain = (F.when(number < 5, "web").when(number < 10, "news").when(number < 15, "books")
              .otherwise("forum"))
    return {"domain": domain}


@query()
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, half of the leaves short: up to two epochs of each document."""
    mix = mixing.Mix(MIX_LEVELS, MIX_WEIGHTS, share=1.0, max_epochs=2)
    docs = table(spark, sf_dir, "documents").drop("domain").withColumns(domain_column())
    out = mixing.mix_sources(docs, mix)
    return out.select("doc_id", "domain", "lang", "source", F.col("mix_epoch").alias("epoch"))


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


SHINGLES_SQL = """
words as (
  select doc_id, [x for x in string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x20\\x09-\\x0D]+') if x <> ''] as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i
        from words where len(w) > 0)
)"""


@query(f"""
with recursive {SHINGLES_SQL},
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b
  on a.s = b.s and a.doc_id <> b.doc_id join sizes x on x.doc_id = a.doc_id
  join sizes y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(doc_id, label) as (
  select doc_id, doc_id from documents
  union
  select l.b, r.label from reach r join links l on l.a = r.doc_id
)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(label) as component_id
from reach r left join sizes s on s.doc_id = r.doc_id group by r.doc_id
""")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed(
        "id", "doc_id"
    )


@query("""
with coded as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
         sha1(coalesce(html, '')) as h
  from pages
), digested as (
  select page_id, payload_bytes, translate(
      lpad(to_base(('0x' || h[1:10])::bigint, 32), 8, '0')
      || lpad(to_base(('0x' || h[11:20])::bigint, 32), 8, '0')
      || lpad(to_base(('0x' || h[21:30])::bigint, 32), 8, '0')
      || lpad(to_base(('0x' || h[31:40])::bigint, 32), 8, '0'),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest
  from coded
), grouped as (
  select *, max(page_id) over (partition by payload_digest) as last_id from digested
)
select page_id, payload_bytes, payload_digest,
       case when page_id = last_id then 'response' else 'revisit' end as record_type,
       case when page_id <> last_id then last_id end as refers_to
from grouped
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, normalised and read back; the rows are those of the sidecar index."""
    raw = warc.write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc-raw"))
    archives = warc.normalise(spark, raw, shared_dir(spark, "warc"))
    index = warc.write_index(spark, archives, shared_dir(spark, "warc-index"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", "refers_to")


@query()
def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", "text", ppm.held_out(F.col("doc_id")).alias("held_out"))
    model = ppm.train(own.filter(~F.col("held_out")))
    return ppm.score(own, model, keep=("doc_id", "held_out")).withColumn(
        "train_tokens", F.lit(model.tokens).cast("long")
    )


@query()
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every text with a window like a benchmark item; clean texts have no row."""
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).withColumnRenamed("id", "doc_id")


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn(
        "toxic", F.col("p_toxic") >= toxicity.REJECT_FROM
    )


WORDS_SQL = """[x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']"""


@query(f"""
with words as (select doc_id, unnest({WORDS_SQL}) as w from documents),
wanted as (select unnest({WORDS_SQL}) as w from benchmark),
coded as (
  select w, (xor(list_reduce(flatten([
      [('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2])::bigint, 0, 0, 0, 0, 0, 0, 0]
      for i in range(octet_length(encode(w)))]),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint),
    4294967295) % 10000) as bucket
  from (select w from words union select w from wanted)
), have as (select bucket, count(*) as s from words join coded using (w) group by bucket),
want as (select bucket, count(*) as t from wanted join coded using (w) group by bucket),
total as (select (select count(*) from words) as all_s, (select count(*) from wanted) as all_t),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (all_s + 10000)::double
                                 / ((s + 1)::double * (all_t + 10000)::double))) as gain
  from have left join want using (bucket), total
), weighed as (
  select doc_id, count(gain) as n_features, coalesce(floor(sum(gain) / count(gain)), 0)::bigint as weight
  from documents left join (select doc_id, gain from words join coded using (w)
                            join gains using (bucket)) using (doc_id) group by doc_id
), scored as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5::double)
                                         / 4294967296::double)))::bigint as score
  from weighed
), placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
         count(*) over (partition by n_features >= 20) as n
  from scored
)
select doc_id, n_features, weight, score,
       case when n_features >= 20 and place <= 10 * n // 100 then place end as rank
from placed
""")
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score",
                      F.col("rank").cast("long").alias("rank"))


def _license_rows() -> str:
    """The templates as SQL literals: number, label, words, needed words, whether a phrase."""
    return ", ".join(
        f"({t.number}, '{t.label}', {list(t.words)}, {t.need}, {str(t.phrase).lower()})"
        for t in licenses.templates())


@query(f"""
with docs as (select doc_id, {WORDS_SQL} as w from documents),
templates(template, label, tw, need, phrase) as (values {_license_rows()}),
placed as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos, w from docs),
places as (
  select doc_id, label, pos from placed, templates
  where phrase and word = tw[1] and w[pos + 1 : pos + len(tw)] = tw
), base as (
  select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word,
         list(distinct label) as base_set
  from places group by doc_id
), hits as (
  select distinct doc_id, template, label, need, len(tw) as size, len(list_distinct(tw)) as d, word, pos
  from placed join (select *, unnest(tw) as word from templates where not phrase) using (word)
), blocks as (
  select a.doc_id, a.label, a.d, count(distinct b.word) as n
  from hits a join hits b on a.doc_id = b.doc_id and a.template = b.template
    and b.pos >= a.pos and b.pos < a.pos + a.size
  group by a.doc_id, a.template, a.label, a.pos, a.d, a.need having count(distinct b.word) >= a.need
), more as (
  select doc_id, list(distinct label) as more_set, max(n / d) as share from blocks group by doc_id
)
select docs.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base_set, [])), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []),
                                                           coalesce(more_set, [])))), ',') as labels,
       case when n_base > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from docs left join base using (doc_id) left join more using (doc_id)
""")
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("""
with drawn as (
  select doc_id, coalesce(text, '') as x, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h
  from documents
), cuts as (
  select *, ('0x' || h[1:8])::bigint % (n + 1) as a, ('0x' || h[9:16])::bigint % (n + 1) as b,
         case when n = 0 or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>')
                   or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
              when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, substring(x, 1, least(a, b)) as p, substring(x, least(a, b) + 1, abs(a - b)) as m,
         substring(x, greatest(a, b) + 1, n - greatest(a, b)) as s
  from cuts
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(x) as restored_sha256
from parts
""")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    return fill_middle.restore(samples).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
