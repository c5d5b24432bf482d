import threading
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.predicates import matches
from tessera.functions.text import tokenize
from tessera.functions.vectors import cosine
from tessera.operators import dense, degrade, keyword, rerank, retrieve, store, tasks
from tessera.plans import catalog
from tessera.sources import files
from tessera.streaming import ingest
from tests.test_docx import make, p


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, embedding array<float>, source_id string, chunk_index int, pos int")


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    with pytest.raises(store.MissingCollection):
        s.info("k")
    s.ensure("k", 2, "m")
    s.ensure("k", 2, "m")
    with pytest.raises(store.DimensionMismatch):
        s.ensure("k", 3, "m")
    with pytest.raises(store.ModelMismatch):
        s.ensure("k", 2, "other")
    s.upsert("k", batch(spark, [("a", "old", [1.0, 0.0], "s", 0, 0), ("a", "new", [0.0, 1.0], "s", 0, 1), ("b", "b", [1.0, 1.0], "s", 1, 2)]))
    assert {(r.id, r.text) for r in s.rows("k").collect()} == {("a", "new"), ("b", "b")}
    with pytest.raises(store.DimensionMismatch):
        s.upsert("k", batch(spark, [("c", "c", [1.0], "s", 0, 0), ("d", "d", [1.0, 1.0], "s", 0, 0)]))
    assert s.count("k") == 2 and s.count("k", {"text": "b"}) == 1
    with pytest.raises(ValueError):
        s.delete("k")
    with pytest.raises(ValueError):
        s.delete("k", given={})
    assert s.delete("k", ids=["a", "zz"], given={"chunk_index": 0}) == 1
    assert [r.id for r in s.rows("k").collect()] == ["b"]
    s.drop("k")
    with pytest.raises(store.MissingCollection):
        s.rows("k")


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (store.Store(spark, f"file://{tmp_path}") for _ in range(2))
    one.ensure("k", 1)
    two.ensure("k", 1)
    seen = one.info("k")
    two.upsert("k", batch(spark, [("b", "b", [1.0], "s", 0, 0)]))
    assert not one._point("k", seen, seen["number"])  # the other was first: the pointer stays
    threads = [threading.Thread(target=s.upsert, args=("k", batch(spark, [(x, x, [1.0], "s", 0, 0)]))) for s, x in ((one, "c"), (two, "d"), (one, "e"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.id for r in one.rows("k").collect()} == {"b", "c", "d", "e"}
    folder = next(tmp_path.iterdir())
    assert len([f for f in folder.iterdir() if f.name.startswith("v-")]) == 2


def test_failing_channel_and_failing_model(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "apple pie", [1.0, 0.0]), ("b", "banana apple", [0.9, 0.1])], "id string, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "apple", [1.0, 0.0])], "query_id long, text string, vector array<double>")

    def broken(query, texts):
        raise ConnectionError("no model")

    out, _ = retrieve.retrieve(rows, q, "dense", 2, model=broken)
    assert [r.id for r in out.orderBy("rank").collect()] == ["a", "b"]
    whole = dense.dense_topk
    monkeypatch.setattr(dense, "dense_topk", lambda *a: whole(*a).where(F.raise_error(F.lit("down")).isNull()))
    out, said = retrieve.retrieve(rows, q, "hybrid", 2)
    assert out.count() == 2 and said["channels"] == ["keyword"] and said["mode"] == "keyword" and said["degradations"][0]["stage"] == "vector"
    with pytest.raises(Exception, match="down"):
        retrieve.retrieve(rows, q, "dense", 2)[0].collect()


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([("b", "one two two"), ("a", "two three"), ("c", "")], "id string, text string")
    q = spark.createDataFrame([(1, "two"), (2, "three one")], "query_id long, text string")
    keyword.save(keyword.index(docs), f"{tmp_path}/ix")
    want = keyword.keyword_topk(docs, q, 5).collect()
    assert sorted(want) == sorted(keyword.keyword_topk(docs, q, 5, ix=keyword.load(spark, f"{tmp_path}/ix")).collect()) and len(want) == 4


def test_stream_equals_batch_and_drops_stale_tail(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("apple. " * 700)
    (src / "b.docx").write_bytes(make(p("banana")))
    (src / "bad.pdf").write_text("not a pdf")
    (src / "empty.txt").write_text("")
    s = store.Store(spark, f"file://{tmp_path}/kb")
    embed = lambda c: ingest.keyword_embedding(c, ["apple", "banana"])
    for kb in ("batch", "stream"):
        s.ensure(kb, 2)
    ingest.ingest(spark, f"file://{src}", s, "batch", embed)
    ingest.start(spark, f"file://{src}", s, "stream", embed, f"file://{tmp_path}/cp").awaitTermination()
    key = lambda kb: sorted((r.id, r.text) for r in s.rows(kb).collect())
    assert key("batch") == key("stream") and len(key("batch")) > 3
    (src / "a.txt").write_text("apple")
    ingest.ingest(spark, f"file://{src}", s, "batch", embed)
    assert sorted(r.text for r in s.rows("batch").collect()) == ["apple", "banana"]
    errors = files.extract(files.scan(spark, f"file://{src}")).where("error is not null").collect()
    assert [r.source.endswith("bad.pdf") for r in errors] == [True]


def test_registry():
    r = files.Registry({"txt": lambda b: "1"})
    with r.temporary():
        r.register(".TXT", lambda b: "2")
        assert r.get("txt")(b"") == "2"
    assert r.get("Txt")(b"") == "1"
    with pytest.raises(ValueError):
        r.get("pdf")


def test_filters_are_typed(spark):
    rows = spark.createDataFrame([(1, '{"n": 1, "s": "1", "b": true, "x": null, "q\\"": "y", "f": 1.0}')], "id int, j string").withColumn("m", F.parse_json("j"))
    hit = lambda g: rows.where(matches(g, {"id": F.col("id")}, F.col("m"))).count() == 1
    assert hit({}) and hit({"n": 1}) and hit({"n": [2, 1.0]}) and hit({"f": 1}) and hit({"s": "1"}) and hit({"b": True})
    assert hit({"x": None}) and hit({"none": None}) and hit({"none": [None]}) and hit({"id": 1, "n": 1}) and hit({'q"': "y"})
    assert not any(map(hit, ({"n": "1"}, {"s": 1}, {"b": 1}, {"n": True}, {"n": []}, {"none": "x"}, {"id": 2, "n": 1})))


def test_dense_ties_and_zero(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.id, r.score) for r in dense.dense_topk(rows, q, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]
    assert spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0.0
    with pytest.raises(ValueError):
        dense.dense_topk(rows, q, 0)


def test_cosines_of_all_pairs_equal_the_scalar_ones(spark):
    v = [[1.0, 2.0], [0.0, 0.0], [-3.0, 0.5], None, [1.0, None], [float("nan"), 1.0], [-2.0, 1.0], [127.0, 2.0**0.5], [0.0078125, 0.0]]
    rows = spark.createDataFrame([*enumerate(v)], "id long, embedding array<float>").repartition(1)
    q = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    show = lambda df: sorted((r.query_id, r.id, repr(r.score)) for r in df.collect())
    got = dense.cosines(rows, q, 6)
    want = rows.crossJoin(q).select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
    assert show(got) == show(want) and got.count() == len(v) ** 2 and got.rdd.getNumPartitions() > 1
    assert dense.cosines(rows, q.limit(0)).count() == 0
    assert show(dense.cosines(rows.where("embedding is null"), q, 6)) == show(want.where("id = 3"))
    with pytest.raises(Exception, match="differ in length"):
        dense.cosines(rows.union(spark.createDataFrame([(99, [1.0])], rows.schema)), q).collect()


def test_every_pair_is_made_by_blocks(spark, data):
    plan = catalog.queries()["cosine_scalar_every50"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_keyword(spark):
    docs = spark.createDataFrame([("b", "红色 Rust_1 rust"), ("a", "红 rust"), ("c", "")], "id string, text string")
    q = spark.createDataFrame([(1, "RUST rust 红"), (2, "")], "query_id long, text string")
    got = keyword.keyword_topk(docs, q, 5).orderBy("rank").collect()
    assert {r.query_id for r in got} == {1} and {r.id for r in got} == {"a", "b"} and all(r.score > 0 for r in got)


ODD = [None, "", "Ünï_9 x", "\u212a K k \u0130I ſS", "\u33ff\u3400\u4dbf\u4dc0\u4dff\u4e00\u9fff\ua000 a漢b字字", "A_a a_A \U00020000 9 \x00z", "b " * 50 + "a", "…é—ß中"]


def test_tokens_are_counted_where_the_text_is(spark):
    docs = spark.createDataFrame([*enumerate(ODD)], "id long, text string")
    postings = keyword.index(docs).postings
    got = sorted((r.id, r.term, r.tf, r.len) for r in postings.collect())
    each = docs.select(F.col("id").cast("string").alias("id"), tokenize(F.col("text")).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    assert got == sorted((r.id, r.term, r.tf, r.len) for r in each.groupBy("id", "len", "term").agg(F.count("*").alias("tf")).collect()) and len(got) > 15
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    twice = {(r.term, r.len): r.tf for r in keyword.index(docs.where("id = 6").union(docs.where("id = 6"))).postings.collect()}
    assert twice == {("b", 51): 100, ("a", 51): 2}


def test_keyword_search_lists_no_matches(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(ODD * 4), (99, "k")], "id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "k a b"), (1, "b 字"), (2, "字 x ü"), (3, "no_such"), (4, None), (5, "S k k")], "query_id long, text string")
    monkeypatch.setattr(keyword, "CELLS", 20)  # more than one block
    monkeypatch.setattr(keyword, "BLOCK", 2)
    for k, where in ((1, None), (3, F.col("id") > 7), (100, None)):
        hits = keyword.bm25(keyword.index(docs), q)
        if where is not None:
            hits = hits.join(docs.where(where).select(F.col("id").cast("string").alias("id")), "id", "left_semi")
        got = keyword.keyword_topk(docs, q, k, where)
        show = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in df.collect())
        assert show(got) == show(dense.ranked(hits, k)) and {r[0] for r in show(got)} == {1, 2, 5}
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    same = docs.union(docs.where("id = 2"))  # an id that two rows share
    assert keyword.keyword_topk(same, q, 5).where("query_id = 2 and id = '2'").first().score > got.where("query_id = 2 and id = '2'").first().score


def test_equal_scores_are_bounded():
    best = keyword._Best([7], 2)
    for x in "zyx":
        best.add(pa.array([x + "c", x + "a", x + "b", x + "d"]), np.array([[1.0, 1.0, 1.0, 0.0]]))
        best._trim()
        assert len(best.held[0]) == 2
    best.add(pa.array(["e"]), np.array([[1.5]]))
    assert best.batch().to_pydict() == {"query_id": [7, 7, 7], "id": ["e", "xa", "xb"], "score": [1.5, 1.0, 1.0]}


def test_retrieve_modes_and_rerank(spark):
    rows = spark.createDataFrame([("a", "apple pie", [1.0, 0.0]), ("b", "banana apple", [0.9, 0.1]), ("c", "cherry", [0.0, 1.0])], "id string, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "apple", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    out, said = retrieve.retrieve(rows, q, "hybrid", 2, model=lambda query, texts: [float(len(t)) for t in texts])
    assert [r.id for r in out.orderBy("rank").collect()] == ["b", "a"] and said["reranked"] and said["fetch_k"] == 20
    out, said = retrieve.retrieve(rows, q, "keyword", 2, level=2)
    assert out.count() == 1 and said["effective_top_k"] == 1
    with pytest.raises(ValueError):
        retrieve.limits(0, None, 0)


def test_misaligned_scores_keep_recall_order(spark):
    c = spark.createDataFrame([(1, 0, "a", 0.9), (1, 1, "b", 0.8)], "query_id long, pos int, id string, score double")
    s = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.7)], "query_id long, pos int, score double")
    got = rerank.apply_scores(c, s).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"] and not any(r.reranked for r in got)


def test_logs_are_folded_by_partition(spark, monkeypatch):
    kinds = ("claim", "stage", "progress", "heartbeat", "handoff", "cancel", "failed", "retry", "succeeded")
    rows = [(t, seq, kinds[(seq * 7 + len(t or "") * seq * seq) % 9], None if seq == 5 else datetime(1970, 1, 1) + timedelta(seconds=seq), "w" if seq % 4 == 0 else None, f"s{seq}", [None, float("nan"), 0.5, 7.0][seq % 4]) for t in ("a", "bb", "ccc", None, "longest") for seq in range(30 if t == "longest" else 12)]
    events = spark.createDataFrame(rows[::-1], "task_id string, seq int, type string, at timestamp, worker string, stage string, progress double").repartition(5)
    monkeypatch.setattr(tasks, "EVENTS", 7)  # logs go over batches
    got = tasks.fold_tasks(events)
    want = []
    for t in {r[0] for r in rows}:
        s = tasks.fold([{"type": r[2], "at": r[3], "worker": r[4], "stage": r[5], "progress": r[6]} for r in rows if r[0] == t])
        want.append((t, *(s[c] for c in got.columns[1:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert "MapInArrow" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroups" not in plan


def test_folds():
    assert degrade.fold_levels([3, 0, 0, 0, 0], [0, 10, 30, 50, 60]) == [3, 3, 2, 2, 1]
    e = lambda t, **k: {"type": t, "at": 1, **k}
    s = tasks.fold([e("claim", worker="w"), e("stage", worker="w", stage="x"), e("stage", worker="old", stage="y"), e("succeeded", worker="w"), e("failed")])
    assert (s["status"], s["stage"], s["stages"], s["ignored"], s["progress"]) == ("succeeded", "x", 1, 2, 1.0)
    s = tasks.fold([e("claim", worker="w"), e("handoff", worker="w"), e("claim", worker="v"), e("cancel"), e("cancelled", worker="v")])
    assert (s["status"], s["attempts"]) == ("cancelled", 1)
