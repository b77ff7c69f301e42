"""The sharding query beside figures of each row, and its evenness over seeds."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from tablecheck.llm.queries import QUERIES
from tablecheck.llm.shuffle_shards import uniform_shards
from tests.llm.helpers import docs


def test_query_rows_equal_brute_force(spark, tmp_path):
    rows = [(i, ["", None, "ä b", "long " * 5000, "x"][i % 5]) for i in range(203)] + [(None, "n"), (None, None), (7, "again"), (7, "again")]
    docs(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op8_uniform_shards"](spark, str(tmp_path)).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in raw)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(40) for k in range(counts[s])]
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_places_are_even_over_seeds(spark):
    rows = docs(spark, [(i, "t") for i in range(30)]).select("doc_id", "text")
    seen = Counter()
    for seed in range(12):
        got = uniform_shards(rows, 3, seed=f"s{seed}").select("doc_id", "shard", F.expr("slot >= 5").alias("late"))
        seen.update((r.shard, r.late) for r in got.where("doc_id < 10").collect())
    # 120 draws over six equally likely halves of shards: 20 each, standard deviation about 4
    assert len(seen) == 6 and max(abs(n - 20) for n in seen.values()) <= 16


def test_rows_of_one_id_are_spread_by_their_texts(spark):
    rows = docs(spark, [(None, f"t{i}") for i in range(300)]).select("doc_id", "text")
    got = uniform_shards(rows, 7, payload=["doc_id", "text"]).collect()
    assert sorted(r.text for r in got) == sorted(f"t{i}" for i in range(300))
    counts = Counter(r.shard for r in got)
    assert sorted(counts.values()) == [42] + [43] * 6
    assert [r.text for r in sorted(got, key=lambda r: (r.shard, r.slot))] != sorted(r.text for r in got)
