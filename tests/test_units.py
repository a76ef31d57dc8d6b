"""Ledgers, streams, models, ladders and scalars on small fixtures."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.functions import scalars as fn
from lotlens.operators import asof, experiments as ex, features as ft, gate, model as ml, revisions as rv, selection as sel, text as tx, vectors as vc
from lotlens.operators.ledger import Ledger
from lotlens.sources import files
from lotlens.streaming import events as st


def test_ledger_is_append_only_and_idempotent(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"), ["lot", "model"], "lot int, model string, score double, note string")
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.1), (1, "a", 0.9)], "lot int, model string, score double")
    assert book.append(rows, ["lot", "score"]) == 2 and book.append(rows, ["lot", "score"]) == 0
    assert book.append(spark.createDataFrame([(3, "a", 0.2)], rows.schema), ["lot"]) == 1
    assert [(r.seq, r.lot, r.score, r.note) for r in book.read().orderBy("seq").collect()] == [(1, 1, 0.5, None), (2, 2, 0.1, None), (3, 3, 0.2, None)]
    assert book.version() == 3 and not any(hasattr(book, x) for x in ("update", "delete"))
    book.assert_covers(rows.select("lot", "model").distinct())
    with pytest.raises(ValueError):
        book.assert_covers(spark.createDataFrame([(9, "z")], "lot int, model string"))


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(src))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    q = st.tumbling(st.read(spark, str(src), schema, 1), "ts", ["event_type"], "7 days", "1 day").writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.event_type, r.window.start): r.n for r in st.tumbling(e, "ts", ["event_type"], "7 days").collect()}
    assert {(r.event_type, r.window.start): r.n for r in spark.table("weeks").collect()} == want
    book = Ledger(spark, str(tmp_path / "book"), ["event_id"], schema)
    for k in range(2):  # a second run from another checkpoint adds nothing
        st.append_ledger(st.read(spark, str(src), schema, 1), book, ["ts", "event_id"], str(tmp_path / f"ck{k}")).awaitTermination()
    assert book.read().count() == e.count() and book.read().select("seq").distinct().count() == e.count()
    q = st.running_counts(st.read(spark, str(src), schema, 1).withColumn("bad", F.col("event_type") == "error"), "user_id", "bad").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r.n for r in spark.table("counts").groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert got == {r.user_id: r.n for r in e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n")).collect()}


def test_model_protocol(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), "ab"[i % 2], int(x + rng.normal() > 0)) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "id int, x double, c string, y int")
    m = ml.fit(df, ["x"], ["c"], "y", trees=3)
    g = ml.grades(ml.score(m, df), "y", ["x", "c"])
    assert g.roc_auc > 0.7 and max(ml.importance(m), key=ml.importance(m).get) == "x"
    assert ml.promotes(g, None, [])[0] and not ml.promotes(g, None, ["too good"])[0]
    assert ml.promotes(ml.Grades(0.5, 0.6, 100, ("a",)), ml.Grades(0.6, 0.6, 100, ("a",)), []) == (False, "worse than the champion")
    assert ml.promotes(ml.Grades(0.1, 0.6, 100, ("a",)), ml.Grades(0.6, 0.6, 100, ("b",)), [])[0]
    assert ml.tripwires(ml.Grades(0.9, 0.9, 9, ()), [], 0.1) == ["too good"]
    known = df.filter("id < 10").select("id")
    assert ml.predict_open(m, df, known, ["id"], "id").count() == 290
    assert ml.contributions(m, df.limit(5), ["x"], ["id"]).count() == 5


def test_ladders():
    assert ex.posterior_best([50, 10], [100, 100])[0] > 0.99
    assert ex.arm_verdict(99, [50, 10], [100, 100], 0, True)[0] == "collecting"
    assert ex.arm_verdict(200, [50, 10], [100, 100], 1, True) == ("ready", 0) and ex.arm_verdict(200, [50, 10], [100, 100], 1, False) == ("leaning", 0)
    m = ex.Measurement
    assert ex.knob_verdict(None, []) == ("hold", None) and ex.knob_verdict(m(0.5, 0.5, 10, 20, 0.0), []) == ("hold", None)
    here = m(0.5, 0.5, 50, 100, 0.01)
    assert ex.knob_verdict(here, [m(0.6, 0.5, 50, 100, 0.01)]) == ("no effect", None)
    assert ex.knob_verdict(here, [m(0.6, 0.9, 90, 100, 0.01)]) == ("move up", 0.6) and ex.knob_verdict(here, [m(0.6, 0.9, 90, 100, 0.5)]) == ("flat", None)
    assert ex.knob_verdict(m(0.5, 0.5, 50, 100, 0.5), [m(0.4, 0.4, 40, 100, 0.0)]) == ("move down", 0.4) and ex.knob_verdict(here, [m(0.6, 0.5, 51, 100, 0.0)], flats=1)[0] == "close"


def test_gate_config():
    c = gate.GateConfig()
    assert len(c.fingerprint()) == 10 and c.overridden({"MIN_RELEVANCE": "0.6"}).min_relevance == 0.6 and c.fingerprint() != c.overridden({"ADMIT": 1}).fingerprint()
    with pytest.raises(KeyError):
        c.overridden({"NO_SUCH": 1})


def test_world_is_strict(spark):
    df = spark.createDataFrame([(1, dt.date(2026, 1, 1)), (2, dt.date(2026, 2, 1)), (3, None)], "id int, pub date")
    w = asof.World("2026-02-01", tenders=(ft.with_roles(df, {"pub": "date"}), "pub"))
    assert [r.id for r in w.tenders.collect()] == [1] and ft.roles_of(w.tenders) == {"pub": "date"}
    with pytest.raises(AttributeError):
        w.awards


def test_revision_rules_ignore_input_order(spark):
    rows = [(1, "a", 3), (1, "b", 3), (2, "c", 1), (None, "d", 9), (None, "e", 9)]
    want = {(1, "b", 3), (2, "c", 1), (None, "d", 9), (None, "e", 9)}
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "k int, v string, n int")
        assert {tuple(x) for x in rv.latest_revision(df, ["k"], [F.desc("n"), F.desc("v")]).collect()} == want
        counts = {(x.v, x.c) for x in rv.running_count(df, ["k"], [F.col("v")], F.col("n") >= 3, "c").collect()}
        assert counts == {("a", 1), ("b", 2), ("c", 0), ("d", 1), ("e", 1)}


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    L = F.lit
    assert tuple(one(spark, *[fn.measure_days(L(v), L(u)) for v, u in (("2.7", "mon"), ("x", "DAY"), ("1e9", "YEAR"), ("3", "moon"))])) == (60, None, None, None)
    bids = F.array(F.struct(L(5.0).alias("amount"), L("EUR").alias("currency")), F.struct(L(7.0).alias("amount"), L(None).cast("string").alias("currency")), F.struct(L(9.0).alias("amount"), L("USD").alias("currency")))
    assert one(spark, fn.bid_sum(bids))[0] == 12.0
    assert tuple(one(spark, fn.fold(L("Größe")), fn.slug(L("Größe & Maß!")), fn.alias_key(L("Müller Bau GmbH & Co. KG")), fn.norm_buyer(L(" Straße  X ")))) == ("Groesse", "groesse-mass", "müller bau", "strasse x")
    assert tuple(one(spark, *[fn.slice_size(L(n), 0.2) for n in (1, 12, 13)], fn.pseudo_ceil(L(100), 0.3401), fn.within_one_edit(L("abc"), L("abd")), fn.within_one_edit(L("abc"), L("xyz")))) == (1, 2, 3, 35, True, False)
    assert one(spark, fn.subsume(F.array(*[L(x) for x in ("dachbau", "dach", "bau", "zimmer", "dach")])))[0] == ["bau", "dach", "zimmer"]
    assert tuple(one(spark, fn.in_market(L(None).cast("string"), L("DE2"), F.array(L("45")), F.array(L("DE"))), fn.deadline_ok(L(None).cast("int"), L(0)), fn.deadline_ok(L(None).cast("int"), L(3)))) == (False, True, False)
    assert tuple(one(spark, tx.repaired(L("Ã¼ber")), tx.repaired(L("über")), tx.repaired(L("plain")))) == ("über", "über", "plain")
    assert fn.window_days("3m") == 90 and fn.window_days("2w") == 14
    low, high = fn.wilson(L(0), L(0))
    assert tuple(one(spark, low, high)) == (None, None)
    fn.register(spark)
    assert spark.sql("SELECT fold_umlauts('ö'), hash_draw('x') < 1, round(wilson_low(5, 10), 4)").first() == ("oe", True, 0.2366)


def test_files(spark, tmp_path):
    assert files.json_paths('{"a": [{"b": 1}, {"c": 2}], "d": null}') == ["a", "a[]", "a[].b", "d"] and files.json_paths("nope") == []
    (tmp_path / "l.csv").write_text("# note\n45,Bau\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.csv")).collect()] == [("45", "Bau")]
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    assert [r.vec for r in files.read_vectors(spark, str(tmp_path / "v.npy")).orderBy("row").collect()][1] == [0, 1, 0]
    (tmp_path / "r.jsonl").write_text(json.dumps({"a": 1}) + "\nbroken\n")
    assert {(r.a, r._broken) for r in files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()} == {(1, None), (None, "broken")}


def test_embedding_interface(spark):
    class Letters:
        dim = 2

        def __call__(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    v = {r.id: r.vec for r in vc.embed(df, "t", Letters).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-6 and v[2] == [0.0, 1.0]
    held = spark.createDataFrame([(1,)], "id int")
    assert [r.id for r in vc.missing(df.withColumn("h", F.lit("x")), held, ["id"], "h").collect()] == [2]


def test_synonyms_and_picks(spark):
    tokens = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "lot int, token string, vec array<double>")
    words = spark.createDataFrame([("w", [1.0, 0.1])], "word string, vec array<double>")
    assert [(r.lot, r.word, r.token) for r in vc.best_synonym(tokens, words, "lot", "token", "word", "vec").collect()] == [(1, "w", "a")]
    picks, ranked = spark.createDataFrame([(1, 10)], "sub int, lot int"), spark.createDataFrame([(1, 11), (2, 12), (2, 13)], "sub int, lot int")
    assert {(r.sub, r.lot) for r in sel.picks_or_ranked(picks, ranked, "sub", [F.col("lot")], 1).collect()} == {(1, 10), (2, 12)}


def test_recipes():
    from lotlens.operators import profiles as pf

    found = {"F": {"soft_floor": 0.4, "soft_consensus": 3, "threshold": 0.66, "code_threshold": 0.8, "soft_threshold": 0.7}, "H": {"soft_floor": 0.5, "soft_consensus": 2, "corroboration": 0.1}}
    f, h = (pf.recipe(gate.GateConfig(), x, found) for x in "FH")
    assert (f.min_relevance, f.min_code_hard, f.min_code_soft, f.soft_floor, f.soft_consensus) == (0.66, 0.8, 0.7, 0.4, 3)
    assert (h.corroboration, h.soft_floor, h.min_relevance) == (0.1, 0.5, gate.GateConfig().min_relevance)
    with pytest.raises(KeyError):
        pf.recipe(gate.GateConfig(), "K", found)
    assert ex.arm_verdict(400, [150, 149], [300, 300], 1, True) == ("no difference", None)


def test_places_and_quantiles(spark):
    from lotlens.operators import ranks

    rng = np.random.default_rng(4)
    rows = [(None if k % 9 == 0 else int(k % 3), int(rng.integers(0, 40)), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(5)
    got = {r.id: (r["__k"], r["__n"]) for r in ranks.placed(df, ["g"], [F.desc("v"), F.col("id")]).collect()}
    for g in (None, 0, 1, 2):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [(k + 1, len(own)) for k in range(len(own))]
    q = {r.g: (r.q0, r.q1, r.n) for r in ranks.quantiles(df, ["g"], "v", [0.1, 0.5]).collect()}
    assert all(np.allclose(q[g][:2], np.quantile([r[1] for r in rows if r[0] == g], [0.1, 0.5])) for g in q) and len(q) == 4
    whole = ranks.quantiles(df, [], "v", [0.95]).first()
    assert abs(whole.q0 - np.quantile([r[1] for r in rows], 0.95)) < 1e-9 and whole.n == 900
    assert ranks.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0 and ranks.placed(df.limit(0), [], ["v"]).count() == 0
