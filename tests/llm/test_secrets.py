"""Base spans against Python's re; weak parts only beside complementary ones; masking."""

import random
import re

from pyspark.sql import functions as F

from mixolve.llm.secrets import redact, scan, spans_text

ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PARTS = ["password", "Secret", "API_KEY", "token=", ": ", "= '", '"', "AKIA" + "B" * 16, "AKIAX", "0f" * 14, "abc", "é😀", " ", "\n", "token: api:secretxyz", "token=token:abcdef", "passwd=short", "x" * 40]


def test_base_spans(spark):
    rng = random.Random(4)
    texts = [None, "", "password=hunter22", "AKIA" * 6, "f" * 24, "F" * 30] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in scan(df).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == base(t or ""), repr(t)
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}


def test_weak_parts_need_each_other(spark):
    key = "Zx9" + "aB3dE" * 7
    far = "word " * 100
    texts = {
        1: f"client_id: app-123 uses {key} at https://api.example.com/v1 now",
        2: f"only {key} here",
        3: f"client_id: app-123 {far}{key}",
        4: "login: bob at https://example.com/x",
        5: f"user=bob {key} {far} https://example.com",
        6: f"user=bob token={key}",
    }
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] * 2, "doc_id long, text string")
    got = {}
    for r in scan(df).select("doc_id", spans_text("spans").alias("s")).collect():
        got.setdefault(r.doc_id, []).append([x.split(":")[0] for x in r.s.split(",") if x])
    assert got == {1: [["ident", "secret", "endpoint"]] * 2, 2: [[]] * 2, 3: [[]] * 2, 4: [[]] * 2, 5: [["ident", "secret"]] * 2, 6: [["ident", "assign"]] * 2}


def test_masking(spark):
    text = "é password=hunter22 and " + "ab" * 12 + " end"
    df = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.m for r in scan(df, keep_text=True).select("doc_id", redact(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {1: "é [SECRET] and [SECRET] end", 2: "clean", 3: None}
    assert scan(df.limit(0)).count() == 0


def test_long_parts_reach_over_bins(spark):
    long = "Ab1" * 400
    df = spark.createDataFrame([(1, f"{long} user=bob"), (2, f"user=bob {long} https://a.example"), (3, f"user=bob {'w ' * 200}{long}")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in scan(df).select("doc_id", spans_text("spans").alias("s")).collect()}
    assert got == {1: "secret:0:1200,ident:1201:1209", 2: "ident:0:8,secret:9:1209", 3: ""}


def test_sql_gives_the_same_rows(spark, tmp_path):
    import duckdb

    from mixolve.llm.queries import ORACLES, op9_secrets

    rng = random.Random(9)
    parts = [*PARTS, "user=bob", "https://a.example/x", " " * 90, "Zx9" + "aB3dE" * 7, "login: al"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(200)] + [(1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op9_secrets"])
    got = op9_secrets(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert sum("secret" in r[-1] for r in want.fetchall()) > 5


def test_a_text_of_very_many_matches(spark):
    import time

    one = "ab" * 12 + " x é "
    text = one * 200_000
    df = spark.createDataFrame([(1, text), (2, "token=abcdef " * 3000 + "y" * 9000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in scan(df, keep_text=True).select("doc_id", F.size("base").alias("n"), F.element_at("base", -1).alias("last"), redact(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got[1].n == 200_000 and tuple(got[1].last) == (len(one) * 199_999, 2, len(one) * 199_999 + 24)
    assert got[1].m == "[SECRET] x é " * 200_000 and got[2].m == "[SECRET] " * 3000 + "y" * 9000
    assert time.time() - began < 60  # some 16 s of four cores


def test_masking_overlaps_against_plain_python(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.randint(1, 60)))
        spans = sorted((a, rng.randint(0, 5), min(len(text), a + rng.randint(1, 9))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 8))))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,kind:int,end:int>>")
    got = {r.id: r.m for r in df.select("id", redact(F.col("text"), F.col("spans"), "#", 7).alias("m")).collect()}
    for i, text, spans in rows:
        at, out = 0, ""
        for a, _, z in spans:
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, z)
        assert got[i] == out + text[at:]
