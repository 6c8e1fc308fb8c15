"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import ship

from .divergence import divergence
from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .mixing import mix
from .near_dedup import near_dedup
from .ngram_join import ngram_join
from .packing import pack
from .quality_rules import quality
from .resampling import resample
from .secret_scan import scan
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # the table has no paths: a document lies in the folder of its language within that of its source
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return license_scan(docs, path)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), k=3, similarity=(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).selectExpr("doc_id", "keep_id", "group_size", "kept", "digest as text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(_table(spark, sf_dir, "documents"), k=4, similarity=(85, 100))
    return joined.select("doc_id", "n_shingles", "component_id")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": """
            with d as (select doc_id, coalesce(text, '') as t from documents)
            select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
                   doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
            from d
        """,
        "op11_source_divergence": """
            with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
            groups as (select distinct lang, source from d),
            occ as (select lang, source, r, unnest(terms) as term from d),
            kept as (select lang, term from occ group by lang, term having count(distinct r) >= 3),
            counts as (select lang, source, term, count(*)::hugeint as n from occ semi join kept using (lang, term) group by all),
            sizes as (select lang, count(*)::hugeint as v from kept group by lang),
            cells as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n
                      from groups g join kept k using (lang) left join counts c using (lang, source, term)),
            p as (select *, 1 + (1000000000 * (n + 1)) // (sum(n) over (partition by lang, source) + v) as p
                  from cells join sizes using (lang)),
            q as (select lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) over (partition by lang) + v) as q
                  from (select lang, term, sum(n)::hugeint as n from cells group by all) join sizes using (lang)),
            pairs as (select lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
                      from p a join p b using (lang, term) where a.source <> b.source group by all),
            every as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value
                      from groups g join groups h on g.lang = h.lang and g.source <> h.source
                      left join pairs on pairs.lang = g.lang and pairs.source = g.source and pairs.item = h.source
                      union all
                      select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p join q using (lang, term) where n > 0 and p > q)
            select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
            from every qualify part = 'pair' or rank <= 200
        """,
        "op13_importance_resampling": """
            with bytes as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                                                   lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as crc
                           from (select unnest(range(256)) as i)),
            texts as (select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
            words as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
            found as (select kind, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                                || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as f from words),
            counted as (select kind, id, f, count(*) as n from found group by all),
            hashed as (select f, xor(list_reduce([4294967295] || list_transform(range(0, len(hex(encode(f))), 2), lambda i: ('0x' || hex(encode(f))[i + 1 : i + 2])::bigint),
                                                 lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
                       from (select distinct f from counted), bytes),
            held as (select kind, id, bucket, sum(n)::double as n from counted join hashed using (f) group by all),
            sums as (select coalesce(sum(n) filter (kind = 0), 0) as s, coalesce(sum(n) filter (kind = 1), 0) as t from held),
            gains as (select bucket, floor(1000 * ln((coalesce(sum(n) filter (kind = 1), 0) + 1) * (any_value(s) + 10000)
                                                     / ((coalesce(sum(n) filter (kind = 0), 0) + 1) * (any_value(t) + 10000)))) as gain from held, sums group by bucket),
            weighed as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from held join gains using (bucket) where kind = 0 group by id),
            scored as (select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || id), 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
                       from words left join weighed using (id) where kind = 0),
            ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as able from scored where n_words >= 20)
            select doc_id, n_features, weight, score, case when rank <= 5 * able // 100 then rank end as rank from scored left join ranked using (doc_id)
        """,
    }
