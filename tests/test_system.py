"""Files to verdicts, caches, commands, streams, and every query against DuckDB."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom import cli, providers
from claimloom.functions.embedding import embed, embed_text
from claimloom.operators import pipeline, reports, store
from claimloom.operators.vectors import near_vectors
from claimloom.plans import catalogue
from claimloom.sources import responses, sinks
from claimloom.sources.files import new_files, scan_files
from claimloom.sources.tables import table
from claimloom.streaming import ingest


def documents(folder):
    os.makedirs(folder / "deep")
    (folder / "a.txt").write_text("ANNUAL REPORT\n\n(Rs in crore)\n\nTotal income of Acme Limited stood at 8,142 Rs Cr for FY24.\n\f\nTotal income of Acme Limited stood at 8,142 Rs Cr for FY23.")
    (folder / "deep" / "b.txt").write_text("Total income of Acme Ltd reached 81,420 INR million for FY24.\n\nGrowth of Acme Ltd was 7 per cent for FY24.")
    (folder / "deep" / "copy.txt").write_text((folder / "a.txt").read_text())
    (folder / "empty.txt").write_text("")
    (folder / "c.bin").write_bytes(b"\x00\xff")


def test_commands(spark, tmp_path, capsys):
    documents(tmp_path / "in")
    out = f"file://{tmp_path}/out"
    assert cli.main(["build", out, f"file://{tmp_path}/in"], spark) == 0
    verdicts = table(spark, out, "verdict").collect()
    assert [r["rule_id"] for r in verdicts if r["verdict"] == "corroborates"] == ["UNIT_SCALE"]
    assert table(spark, out, "witness").count() == 2 and table(spark, out, "claim").count() == 4
    for command in ("stats", "cases", "checkpoint", "adjudicate"):
        assert cli.main([command, out], spark) == 0
    assert "UNIT_SCALE" in capsys.readouterr().out
    assert cli.main(["ingest", out, f"file://{tmp_path}/in"], spark) == 0
    spark.catalog.clearCache()
    assert table(spark, out, "witness").count() == 2
    with pytest.raises(ValueError):
        cli.main(["reset", out], spark)
    assert cli.main(["reset", out, "--yes"], spark) == 0
    assert table(spark, out, "claim").count() == 0


def test_two_ingests_and_two_notations(spark, tmp_path, monkeypatch):
    """Two files by two ingests: claims keep numbers of their own, one figure in two notations and two related measures are told."""
    (tmp_path / "in").mkdir()
    out = f"file://{tmp_path}/out"
    first = "Annual report\n\nPublisher: Acme Limited\n\nPublished: 2024-05-17\n\n(Rs in crore)\n\n"
    (tmp_path / "in" / "a.txt").write_text(first + "Total income of the Company stood at 8,142 Rs Cr for FY24.\n\nRevenue from express freight services of Acme Limited was 500 Rs Cr for FY24.")
    assert cli.main(["ingest", out, f"file://{tmp_path}/in"], spark) == 0
    (tmp_path / "in" / "b.txt").write_text("Total income of Acme Ltd reached 81,420 INR million for FY24.\n\nRevenue from freight of Acme Ltd was 470 Rs Cr for FY24.")
    assert cli.main(["ingest", out, f"file://{tmp_path}/in"], spark) == 0
    claims = table(spark, out, "claim").collect()
    assert sorted(r["claim_id"] for r in claims) == [1, 2, 3, 4]
    about = {r["filename"]: r for r in table(spark, out, "witness").collect()}
    assert (about["a.txt"]["publisher"], about["a.txt"]["vintage_raw"], about["a.txt"]["default_currency"], about["b.txt"]["title"]) == ("Acme Limited", "2024-05-17", "INR", "b")
    assert table(spark, out, "anchor").where("x1 > x0 and char_end > char_start").count() == 4
    (tmp_path / "agreeing.py").write_text("class Agrees:\n    def note(self, verdict, explanation):\n        return {'relationship': verdict}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "agreeing.py"))
    for command in (["adjudicate", out, "--adviser", "agreeing:Agrees"], ["quarantine", out], ["frame", out], ["export", out, f"{out}/top.json"]):
        assert cli.main(command, spark) == 0
    verdicts = {(r["claim_a"], r["claim_b"]): r["rule_id"] for r in table(spark, out, "verdict").collect()}
    framed = {r["claim_id"]: r["lemma_key"] for r in table(spark, out, "framed").collect()}
    name = {r["claim_id"]: (r["witness_id"], r["measure_raw"]) for r in claims}
    income = tuple(sorted(c for c, (_, m) in name.items() if m == "Total income"))
    freight = tuple(sorted(c for c, (_, m) in name.items() if "freight" in m))
    assert verdicts[income] == "UNIT_SCALE" and framed[income[0]] == framed[income[1]]
    assert verdicts[freight] == "DEFINITION_DRIFT", (verdicts, framed)
    assert table(spark, out, "note").columns == ["verdict_id", "note", "agrees"] and spark.read.json(f"{out}/top.json").count() == len(verdicts)


def test_an_ingest_that_stops_is_made_good(spark, tmp_path, monkeypatch):
    """A crash after the witness, and one after every other table: the next run gives what one whole run gives."""
    documents(tmp_path / "in")
    whole, broken = f"file://{tmp_path}/whole", f"file://{tmp_path}/broken"
    assert cli.main(["ingest", whole, f"file://{tmp_path}/in"], spark) == 0
    append = sinks.append
    for allowed in (1, 5):
        written = []

        def stop(rows, folder, name):
            if len(written) == allowed:
                raise OSError("lost")
            written.append(name)
            append(rows, folder, name)

        monkeypatch.setattr(sinks, "append", stop)
        with pytest.raises(OSError):
            cli.main(["ingest", broken, f"file://{tmp_path}/in"], spark)
    monkeypatch.setattr(sinks, "append", append)
    assert cli.main(["ingest", broken, f"file://{tmp_path}/in"], spark) == 0
    for name in cli.FILED:
        rows = [sorted(map(str, table(spark, folder, name).collect())) for folder in (whole, broken)]
        assert rows[0] == rows[1], name
    assert {r["status"] for r in table(spark, broken, "witness").collect()} == {"elicited"}


def test_a_batch_is_replayed_after_a_failure(spark, data, tmp_path, monkeypatch):
    """A failure between the two tables, then the batch again: all verdicts are there."""
    claims, witness, out = table(spark, data, "claim"), table(spark, data, "witness"), f"file://{tmp_path}/out"
    append = ingest.append

    def stop(rows, folder, name):
        if name == "verdict":
            raise OSError("lost")
        append(rows, folder, name)

    monkeypatch.setattr(ingest, "append", stop)
    with pytest.raises(OSError):
        ingest.add_claims(claims, witness, out)
    monkeypatch.setattr(ingest, "append", append)
    for _ in range(2):
        ingest.add_claims(claims, witness, out)
        assert table(spark, out, "verdict").count() == catalogue.QUERIES["lemma_pairs"](spark, data).count() > 0
        assert table(spark, out, "framed").count() == claims.select("claim_id").distinct().count()


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from claimloom.session import shared_folder

    unset = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", None):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: unset, master=master), conf=unset)
        with pytest.raises(RuntimeError):
            shared_folder(fake)


def test_files(spark, tmp_path):
    documents(tmp_path / "in")
    files = scan_files(spark, f"file://{tmp_path}/in", "*.txt")
    none = spark.createDataFrame([], "sha256 string, status string")
    assert files.count() == 3 and new_files(files, none).count() == 2
    begun = files.select("sha256", F.when(F.col("filename") == "b.txt", "segmented").otherwise("elicited").alias("status"))
    assert [r["filename"] for r in new_files(files, begun).collect()] == ["b.txt"]


def test_failing_providers_become_rows(spark):
    class Broken:
        def pages(self, content, filename):
            raise OSError("no such format")

        def claims(self, text, header):
            raise ValueError("no answer")

    files = spark.createDataFrame([("h", "f", bytearray(b"x"))], "sha256 string, filename string, content binary")
    assert [r["error"] for r in providers.parse_files(files, Broken()).collect()] == ["OSError: no such format"]
    passages = spark.createDataFrame([(1, 0, "t", None)], "witness_id long, passage_no int, text string, context_header string")
    assert [r["error"] for r in providers.extract_claims(passages, Broken()).collect()] == ["ValueError: no answer"]
    tables = pipeline.ingest(files.withColumn("path", F.lit("p")), spark.createDataFrame([], "witness_id long, sha256 string, status string"), Broken(), Broken())
    assert [r["status"] for r in tables["witness"].collect()] == ["failed"] and tables["claim"].count() == 0


def test_front_matter(spark):
    pages = spark.createDataFrame([(1, n, f"{n}" * 4000) for n in range(9)], "witness_id long, page_no int, text string")
    row = providers.front_matter_text(pages).first()
    assert row["head"] == "\n".join(f"{n}" * 3000 for n in range(6)) and row["tail"] == "\n".join(f"{n}" * 1200 for n in (7, 8))


def test_notes(spark):
    class Says:
        def note(self, verdict, explanation):
            if explanation is None:
                raise ValueError("no context")
            return {"relationship": "contradicts"}

    queue = spark.createDataFrame([(1, "Contradicts ", "x"), (2, "reconciled", "y"), (3, "contradicts", None)], "verdict_id long, verdict string, explanation string")
    assert {r["verdict_id"]: r["agrees"] for r in providers.note_verdicts(queue, Says()).collect()} == {1: True, 2: False}


def test_quarantine_report(spark):
    rows = spark.createDataFrame([(1, 1, "unanchored", "{}"), (2, 1, "unanchored", "{}"), (3, 1, "value_not_in_quote", "{}")], "quote_id long, witness_id long, reason string, payload string")
    reasons, listed = reports.quarantine_report(rows, spark.createDataFrame([(1, "T", "f")], "witness_id long, title string, filename string"), 2)
    assert [tuple(r) for r in reasons.collect()] == [("unanchored", 2), ("value_not_in_quote", 1)] and [r["quote_id"] for r in listed.collect()] == [3, 2]


def test_limits_and_retries():
    now, slept = [0.0], []
    limiter = providers.RateLimiter(2, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(5):
        limiter.acquire()
    assert slept == [60.0, 60.0]
    models = providers.Rotation(["a", "b", "c"], {"a", "c"})
    assert models.current == "a" and models.step() == "c" and models.retire() and models.current == "a" and not models.retire()
    with pytest.raises(ValueError):
        providers.Rotation(["x"], {"y"})
    replies, waits = iter(["", RuntimeError("please retry in 7.5 s"), '{"ok": 1}']), []

    def ask():
        reply = next(replies)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert providers.call_with_retry(ask, sleep=waits.append) == {"ok": 1} and 2 <= waits[0] < 3.1 and 7.5 <= waits[1] < 8.6
    with pytest.raises(PermissionError):
        providers.call_with_retry(lambda: (_ for _ in ()).throw(PermissionError("key")), sleep=waits.append)


def test_response_cache(spark):
    asked = spark.createDataFrame([("p", "s", "u1", "{}"), ("p", "s", "u1", "{}"), ("p", "s", "u2", "{}"), ("p", "s", None, "{}")], "purpose string, system string, user string, schema string")
    keyed = asked.withColumn("request_key", responses.request_key(*[F.col(c) for c in asked.columns]))
    cache = keyed.select("request_key", F.when(F.col("user") == "u1", '{"a": 1}').otherwise("{broken").alias("response"))
    hits, misses = responses.split_cached(keyed, cache)
    assert hits.count() == 2 and misses.count() == 2
    calls = spark.createDataFrame([("p", True, 1, 10), ("p", False, 5, 20)], "purpose string, cache_hit boolean, tokens int, latency_ms int")
    assert tuple(responses.call_summary(calls).first()) == ("p", 2, 1, 6, 15.0)


def test_sinks(spark, tmp_path):
    out = f"file://{tmp_path}"
    sinks.append(spark.range(5), out, "t")
    sinks.append(spark.range(5), out, "t")
    sinks.replace(spark.read.parquet(f"{out}/t.parquet").where("id > 2"), out, "t")
    sinks.compact(spark, out, "t")
    assert spark.read.parquet(f"{out}/t.parquet").count() == 4 and len(glob.glob(f"{tmp_path}/t.parquet/*.parquet")) == 1
    sinks.export_json(spark.range(3), f"{out}/e.json")
    assert spark.read.json(f"{out}/e.json").count() == 3
    assert sinks.log_row(spark.createDataFrame([("a", 1)], "k string, n long"), "stage").first()["stats"] == '{"a":1}'


def test_json_default(spark):
    rows = spark.createDataFrame([('{"k": 3}',), ("",), (None,), ("{oops",)], "t string")
    assert [r[0] for r in rows.select(store.json_or(F.col("t"), "k int", F.struct(F.lit(None).cast("int").alias("k")))["k"]).collect()] == [3, None, None, None]


def test_embedding(spark):
    rows = spark.createDataFrame([("net revenue",), (None,), ("",)], "p string").select(embed("p").alias("v")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-5 and rows[1]["v"] is None and not any(rows[2]["v"]) and len(embed_text("a b")) == 64


def test_near_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0]), (8, [1.0, None]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert [(r["a"], r["b"]) for r in near_vectors(df, 0.9).collect()] == [(1, 2)]
    assert near_vectors(df.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("floor", [0.68, 0.8, 0.97])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_finds_every_pair(spark, monkeypatch, floor, kind):
    """Many centres, several blocks and copies, beside brute force."""
    from claimloom.operators import vectors

    monkeypatch.setattr(vectors, "PER_CENTRE", 20)
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "STEP", 16, raising=False)
    chance = np.random.default_rng(4)
    v = (chance.normal(size=(600, 8)) + 1.5 * chance.normal(size=(12, 8))[chance.integers(0, 12, 600)]).astype(np.float32)
    v[590:] = v[:10]
    df = spark.createDataFrame([(f"k{i:03}", [float(x) for x in row]) for i, row in enumerate(v)], f"id string, vec array<{kind}>")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = u @ u.T
    want = {(f"k{i:03}", f"k{j:03}") for i, j in zip(*np.nonzero(cosine >= floor)) if i < j}
    got = {(r["a"], r["b"]): r["score"] for r in near_vectors(df, floor).collect()}
    assert set(got) == want and len(want) > 50
    assert all(abs(s - cosine[int(a[1:]), int(b[1:])]) < 1e-9 for (a, b), s in got.items())


def test_stream(spark, data, tmp_path):
    claims = table(spark, data, "claim")
    schema = claims._jdf.schema().toDDL()
    halves = claims.randomSplit([0.5, 0.5], seed=1)
    for i, part in enumerate([*halves, halves[0]]):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        ingest.start(spark, f"file://{tmp_path}/in", schema, data, f"file://{tmp_path}/out", f"file://{tmp_path}/progress").awaitTermination()
    framed = spark.read.parquet(f"file://{tmp_path}/out/framed.parquet")
    assert framed.count() == framed.select("claim_id").distinct().count() == claims.select("claim_id").distinct().count()
    want = {(r["claim_a"], r["claim_b"]) for r in catalogue.QUERIES["lemma_pairs"](spark, data).collect()}
    assert {(r["claim_a"], r["claim_b"]) for r in spark.read.parquet(f"file://{tmp_path}/out/verdict.parquet").collect()} == want
    assert ingest.arrivals(claims).agg(F.sum("n")).first()[0] == claims.count()


def test_executors_need_no_installed_package(data, tmp_path):
    """A query with Python in it, started elsewhere and with nothing on the path of the workers."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {home!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('ROWS', e.queries()['resolved_entities'](s, {data!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 5) + 0.0)
    return str(v)


def compare(spark, folder, run, sql):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = run(spark, folder)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    if name in catalogue.SQL:
        compare(spark, data, catalogue.QUERIES[name], catalogue.SQL[name])
    else:
        df = catalogue.QUERIES[name](spark, data)
        assert df.columns and df.count() >= 0


def test_flagship(spark, data):
    assert catalogue.flagship(spark, data).count() > 0
