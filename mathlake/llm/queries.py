"""The queries of this subpackage for __spark_entry__.py, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, exact, hmm, interaction, lpf, packing, periodic, pii, quality, sharding, simhash, toxicity
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents"), keep_text=False)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.remove_repeats(table(spark, sf_dir, "documents"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op11 reads: of a tenth of the documents the end repeats one stretch."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.runs(table(spark, sf_dir, "documents"), rewrite=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    rows = rows.select("*", longest.alias("m"), F.array_join(F.transform("runs", line), "").alias("lines"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    start, length, period = -F.col("m.col2"), F.col("m.length"), -F.col("m.col3")
    milli = F.expr("1000 * m.length div -m.col3")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.last_of_each(table(spark, sf_dir, "documents"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_store": op2_token_store,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_hmm": op5_hmm,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_repeats": op10_repeats,
    "op11_runs": op11_runs,
    "op12_exact": op12_exact,
    "op13_interactions": op13_interactions,
}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The test items have five words and more here; shorter ones are tested against brute force.
OP6_SQL = f"""
with d as (select doc_id, list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
b as (select distinct item_id, list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark),
ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from d, unnest(range(1, len(w) - 3)) as t(i)),
bs as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s from b, unnest(range(1, len(w) - 3)) as t(i)),
n as (select item_id, count(*) as n_shingles from bs group by 1),
m as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by 1, 2)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment from m join n using (item_id)
where n_shared >= ceil(0.8 * n_shingles - 1e-9)
"""
OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(t) as text_sha256 from d window g as (partition by t)
"""
OP13_SQL = """
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
m as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by t))::int as mask from w),
c as (select part, mask, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as bad from m left join labels using (doc_id) group by 1, 2),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select concat(a.f, b.f, c.f, d.f, e.f) as o from l a, l b, l c, l d, l e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select o, s, substr(o, s, 1) as f, 1 << (ascii(substr(o, s, 1)) - 65) as bit, coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(substr(o, i::int, 1)) - 65))), 0)::int as prior from o, unnest(range(1, 6)) as t(s)),
r as (select part, o, s, f, sum(n) filter (where mask & (prior | bit) = 0) as kept, sum(n) filter (where mask & bit <> 0 and mask & prior = 0) as removed, sum(n) filter (where mask & bit <> 0 and mask & prior <> 0) as redundant, sum(n) filter (where mask = bit) as uniq, sum(good) filter (where mask & bit <> 0 and mask & prior = 0) as good, sum(bad) filter (where mask & bit <> 0 and mask & prior = 0) as bad from c, s group by 1, 2, 3, 4)
select part, o as filter_order, s::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(uniq, 0)::bigint as unique_fails, coalesce(good, 0)::bigint as good_lost, coalesce(bad, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley from r
"""
ORACLE_SQL: dict[str, str] = {"op6_decontamination": OP6_SQL, "op12_exact": OP12_SQL, "op13_interactions": OP13_SQL}
