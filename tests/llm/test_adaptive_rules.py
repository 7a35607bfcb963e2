import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import adaptive_rules as R

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def facts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def brute(rows, least, reach):
    own = [(r, facts(r[1])) for r in rows]
    value = lambda rule, f: 1000 * f[rule.part] // f[rule.whole] if f[rule.whole] else None
    cell = lambda v: v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0)
    values = defaultdict(list)
    for (_, _, lang, source, *_), f in own:
        for rule in R.RULES:
            if (v := value(rule, f)) is not None:
                for key in ((0, lang, source), (1, lang), (2,)):
                    values[key, rule.name].append(cell(v))
    quartile = lambda x, q: sorted(x)[-(-q * len(x) // 100) - 1]
    out = []
    for (doc_id, _, lang, source, *_), f in own:
        failed = f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        keys = [k for k in ((0, lang, source), (1, lang), (2,)) if k[0] == 2 or max((len(values[k, r.name]) for r in R.RULES), default=0) >= least]
        ok = not failed
        for rule in R.RULES:
            v, x = value(rule, f), values[keys[0], rule.name]
            if v is not None and x:
                low, mid, high = (quartile(x, q) for q in (25, 50, 75))
                ok &= rule.below is None or v >= low - reach * max(mid - low, rule.below)
                ok &= rule.above is None or v <= high + reach * max(high - mid, rule.above)
        out.append((doc_id, *(f[c] for c in R.FACTS), failed, ok))
    return out


def rows_of(rng, n=260):
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Ω", "\x1c", "a#", "<b>"]
    texts = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(rng.integers(1, 9))]
        if i % 5 == 0:
            lines += lines[: rng.integers(0, len(lines))] * 2
        if i % 7 == 0:
            lines = [x.replace(" ", "### ") for x in lines]
        if i % 11 == 0:
            lines.append("x" * int(rng.integers(1, 90)) + " " + "long" * 300)
        texts.append(str(rng.choice(["\n", "\n\t ", "\n\n"])).join(lines))
    texts += ["", None, " \n\t", "one two three " * 40, "a b " * 3000, "same " * 2000]
    out = [(int(i), t, [None, "en", "de", "xx"][int(rng.choice(4, p=[0.1, 0.6, 0.25, 0.05]))], ["hot", None, "s1", "s2"][int(rng.choice(4, p=[0.5, 0.1, 0.3, 0.1]))], "clash") for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    return out + [out[0], out[0], (None, out[1][1], "en", "hot", "y"), (out[2][0], "other text", "en", "hot", "y")]


def test_against_brute_force(spark):
    rows = rows_of(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for least, reach in ((40, 4), (1, 1), (1000, 2)):
        got = [tuple(r) for r in R.judged(docs, least=least, reach=reach).select("doc_id", *R.FACTS, "base_failed", "kept").collect()]
        wanted = brute(rows, least, reach)
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
        assert 0 < sum(r[-1] for r in wanted) < len(wanted)


def test_thresholds_follow_the_group(spark):
    """Symbols that are usual in one source are kept there and rejected elsewhere."""
    plain = lambda i: " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(120))
    rows = [(i, plain(i) + " #" * (i % 3), "en", "prose", "") for i in range(200)] + [(1000 + i, plain(i).replace(" ", " | "), "en", "tables", "") for i in range(200)]
    rows.append((5000, plain(5).replace(" ", " | "), "en", "prose", ""))
    got = {r.doc_id: r for r in R.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.kept for i, r in got.items() if i < 5000) and not got[5000].kept
    assert {r.level for r in got.values()} == {0}


def test_sketches_merge(spark):
    rows = rows_of(np.random.default_rng(9))
    whole = R.with_facts(spark.createDataFrame(rows, SCHEMA).drop("n_words"))
    halves = [R.sketches(R.with_facts(spark.createDataFrame(part, SCHEMA).drop("n_words"))) for part in (rows[::2], rows[1::2])]
    merged = halves[0].union(halves[1]).groupBy("level", "lang", "source", "rule", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, R.sketches(whole).collect()), key=repr)


def test_buckets_are_narrow(spark):
    values = [0, 1, 63, 64, 65, 100, 1000, 123_456, 2**40 + 12345]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(R.bucket(F.col("v")).alias("b")).collect()]
    assert all(b <= v and 32 * (v - b) <= v for b, v in zip(got, values, strict=True)) and got[:4] == values[:4]


def test_native_plan(spark):
    docs = spark.createDataFrame(rows_of(np.random.default_rng(1), 40), SCHEMA)
    plan = R.with_facts(docs)._jdf.queryExecution().toString() + R.judged(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_kept_documents(spark):
    rows = rows_of(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1))
    got = R.kept_documents(docs, least=40)
    assert got.columns == docs.columns
    wanted = Counter(r for r, b in zip(rows, brute(rows, 40, 4), strict=True) if b[-1])
    assert Counter(tuple(r)[:-1] for r in got.collect()) == wanted


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = R.judged(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", *R.FACTS, "base_failed", "kept")
    wanted = c.execute(R.rules_sql())
    assert [d[0] for d in wanted.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.judged(empty).collect() == [] and R.kept_documents(empty).collect() == []
