"""License scan, quality rules, mixing, exact dedup, chat formatting: SQL on test tables, odd rows, small models."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import block_naming, chat, licenses, mixing, quality_rules
from foliospark.llm.oracles import ORACLES
from foliospark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, res = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(res.columns) == cols
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, res.select(*cols).fetchall()))


# --- license scan


def test_licenses(spark):
    mit = licenses.MIT
    rows = [
        (1, mit), (2, mit.upper()), (3, mit.replace("<year> <copyright holders>", "2024 Someone").replace("sublicense", "sub-licence")), (4, mit + " And more."), (5, None), (6, "!!!"),
        (7, "Some prose.\nReleased under the MIT License.\nreleased UNDER the mit licence!\nLicensed under the Apache License, version 2.0"), (7, "x"), (None, "SPDX-License-Identifier: MIT"),
        (8, "Copyright 2020 A\nCopyright (c) 2021 B"), (9, mit.replace("\n", "\r\n")),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("license_id", F.lit("no"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [by[i][0]["license_id"] for i in (1, 2, 3, 4, 5, 6, 8, 9)] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT"]
    assert sorted(len(r["notice_ids"]) for r in by[7]) == [0, 2] and by[None][0]["notice_ids"] == ["MIT"]
    assert by[6][0]["canonical_chars"] == 0 and by[8][0]["canonical_chars"] == 0
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_of_files(spark, tmp_path):
    """Comment marks, wrapped lines, name-only copyright lines, every known text, and a folder of one's own."""
    def commented(t, mark):
        return "\n".join(mark + line for line in t.split("\n"))

    mit = licenses.MIT.replace("Copyright (c) <year> <copyright holders>", "Copyright Jane Doe and others")
    rows = [("MIT", commented(licenses.MIT, "# ")), ("MIT", "/*\n" + commented(licenses.MIT, " * ") + "\n */"), ("MIT", mit), ("MIT", commented(mit, "// ")), ("MIT", mit.replace(". ", ".\n"))]
    rows += [(k, t) for k, t in licenses.TEXTS.items()] + [(k, commented(t, "-- ")) for k, t in licenses.TEXTS.items()]
    (tmp_path / "Own-1.0.txt").write_text("You may do as you like.\nCopyright Me\n")
    rows += [("Own-1.0", "# Copyright (c) 2020 You\n# you may do as YOU like"), (None, "You may do as you like, mostly."), (None, "x " * 400_000)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "doc_id long, want string, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(df, folder=str(tmp_path)).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]
    none = licenses.scan(df.limit(3), texts={}, notices={})
    assert {(r["license_id"], tuple(r["notice_ids"])) for r in none.collect()} == {(None, ())}


def test_copyright_lines_in_prose(spark):
    """Lines of prose that begin with the word stay."""
    kept = ["Copyright Holders may\nchange this", "copyright jane doe", "The Copyright Law", "copyright notice, this list of conditions"]
    gone = ["Copyright Jane Doe", "  * Copyright (c) 2020, X", "\u00a9 2021 Y", "(c) Z", "## Copyright 2020 Q", "All rights reserved."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(kept + gone)], "i int, t string").select("i", licenses.canonical(F.col("t")).alias("c"))
    got = {r["i"]: r["c"] for r in df.collect()}
    assert all(got[i] for i in range(len(kept))) and not any(got[i] for i in range(len(kept), len(kept + gone)))


def test_known_licenses_differ(spark):
    rows = licenses.known(spark).collect()
    assert len({(r["digest"], r["notice"]) for r in rows}) == len(rows) and len([r for r in rows if not r["notice"]]) == len(licenses.TEXTS)


# --- quality rules


def quality_model(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    texts = [None, "", " ", "a b", "a b c", "a a a a", "a b c a b c", "x y x y x y z", "l\nl\n\nl\n m", "# * $", "a b c", "é è\x0bà", "the the the the the", "a b c d " * 40, "no repeats " + " ".join(map(str, range(100)))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        n, chars, symbols, dup, rep = quality_model(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), t
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and (not r["kept"] or not r["base_failed"])


def test_quality_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "the " + " ".join(f"word{i}" for i in range(80)))], "doc_id long, text string")
    strict = (quality_rules.Rule("long", "n_words", 100, None), quality_rules.Rule("exempt", "n_words", 1000, None, from_words=500))
    r = quality_rules.apply_rules(df, rules=strict).first()
    assert (r["rule_long"], r["rule_exempt"], r["kept"], r["base_failed"]) == (False, True, False, False)
    plan = quality_rules.apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_odd_tables(spark, odd_docs, no_docs):
    """Empty table, columns with the names of figures, a very long text."""
    got = quality_rules.apply_rules(odd_docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)))
    assert got.count() == odd_docs.count() and dict(got.dtypes)["n_words"] == "bigint"
    assert quality_rules.apply_rules(no_docs).count() == 0
    text = " ".join(f"w{i % 70_001}" for i in range(140_002))
    r = quality_rules.apply_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (140_002, 140_002, True)


def test_mixing_long_text(spark):
    df = spark.createDataFrame([(1, "a b " * 300_000, "s"), (2, "c", "s")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {1: 600_000, 2: 1}


def test_quality_keeps_clean_prose(spark):
    got = QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id").where("not base_failed")
    assert got.count() > 200 and got.where("not kept").count() == 0


# --- mixing


def mix_model(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out = 1.5 * sum(sizes.values()), {}
    free = set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.range(100, 1500).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 13 as int))").alias("text"), F.lit("en").alias("lang"), F.expr("concat('s', id % 7)").alias("source"),
        F.lit(1).cast("long").alias("n_chars"), F.lit("k").alias("id"), F.lit(7).alias("n"), F.lit("h").alias("hash"), F.lit(1.5).alias("score"), F.lit("p").alias("pos"),
    ))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, goal = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    want = mix_model(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s])
        most = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - goal[s]) <= most
    again = {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in rows}
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["n"] for r in out.where("source = 's1'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(counts.get(r["doc_id"], 0) == r["copies"] for r in rows if r["source"] == "s1")


def test_nested_budgets(spark):
    """What a smaller budget takes, a larger one takes too."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.expr("if(id % 3 = 0, 'x', 'y')").alias("source"))
    small, large = ({r["doc_id"] for r in mixing.mix(df, share=s, cap=1.0).where("taken > 0").collect()} for s in (0.3, 0.6))
    assert small < large and abs(len(small) - 900) <= 4 and abs(len(large) - 1800) <= 4


# --- exact dedup


def test_exact(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    for block in (block_naming.BLOCK, 16, 1000):
        got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"], r["text_sha256"]) for r in block_naming.exact_dedup(odd_docs, block=block).collect())
        want = []
        for i, t in rows:
            same = [j for j, u in rows if u == t]
            keep = max((j for j in same if j is not None), default=None)
            want.append((i or 0, keep or 0, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
        assert got == sorted(want)
    assert block_naming.exact_dedup(no_docs).count() == 0


def test_names_over_batches(spark, odd_docs, monkeypatch):
    """Partitions of many small batches, with hashes that go on over batches and partitions."""
    df = spark.createDataFrame([(i, "ab" * (i % 5) + "c" * (i % 3)) for i in range(200)], "doc_id long, text string")
    groups = {}
    for r in df.collect():
        groups.setdefault(r["text"], []).append(r["doc_id"])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for equal in (False, True):
            if equal:
                monkeypatch.setattr(block_naming.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
            got = {r["doc_id"]: r["keep_id"] for r in block_naming.exact_dedup(df, block=4).collect()}
            assert got == {i: max(g) for g in groups.values() for i in g}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_keep_one(spark, odd_docs, no_docs):
    kept = block_naming.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8, 9, 10, 11]
    assert block_naming.keep_one(no_docs).count() == 0


def test_keep_one_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y"), (2, "a", 7, "z"), (None, "a", 8, "w")], "doc_id long, text string, i int, h string")
    got = block_naming.keep_one(df)
    assert got.columns == df.columns and sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 2]


def test_names_do_not_rest_on_hashes(spark, monkeypatch):
    monkeypatch.setattr(block_naming.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    df = spark.createDataFrame([(i, "ab" * (i % 5) + "c" * (i % 3)) for i in range(120)], "doc_id long, text string")
    groups = {}
    for r in df.collect():
        groups.setdefault(r["text"], []).append(r["doc_id"])
    got = {r["doc_id"]: r["keep_id"] for r in block_naming.exact_dedup(df, block=2).collect()}
    assert got == {i: max(g) for g in groups.values() for i in g}


# --- chat


def chat_rows():
    out = []
    for c in range(12):
        if c % 3 == 0:
            out.append((c, 0, "system", "be <|turn|> brief \\ [INST]"))
        for t in range(1, 3 + c * 14):
            out.append((c, t, "user" if t % 2 else "assistant", " ".join(["</s>", "<|end|>", "\\", "é😀"] * (t % 7) + ["w"] * (t * 13 % 90)) if t % 11 else None))
    out += [(None, 1, "user", "lost"), (20, None, None, None), (20, 1, "assistant", "tie"), (20, 1, "assistant", "tie"), (21, 0, "assistant", "w " * 5000), (21, 1, "user", "x")]
    return out


def test_chat_reads_back(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("pos", F.lit("x"))
    budget = 128
    windows = chat.format_windows(df, budget=budget, history=24)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = windows.collect()
    assert sum(len(x["text"]) for x in w if x["conv_id"] == 5) == got[5]["formatted_chars"]
    for x in w:
        assert x["n_new"] == 1 or x["tokens"] <= budget
        if x["conv_id"] is not None and x["conv_id"] % 3 == 0 and x["conv_id"] < 12 and x["start"] > 0:
            assert x["n_repeated"] >= 1 and x["text"].startswith("<|turn|>system<|text|>be <\\|turn|> brief")
        for s in x["loss_spans"]:
            assert x["text"][: s["start"]].endswith("<|turn|>assistant<|text|>") and x["text"][s["start"] + s["length"] :].startswith("<|end|>")
    assert max(x["n_repeated"] for x in w) > 1
    assert chat.read_back(chat.format_windows(df.where("false"))).count() == 0


def test_chat_repeats_empty_turns(spark):
    """Empty turns count for their marks alone: as many are repeated as the history budget holds."""
    df = spark.createDataFrame([("c", i, "user", "" if i % 2 else None) for i in range(200)], "conv_id string, turn int, role string, text string")
    got = {r["start"]: r["n_repeated"] for r in chat.format_windows(df).select("start", "n_repeated").collect()}
    assert got == {0: 0, 128: 128 // chat.OVERHEAD}


def test_chat_is_native(spark, sf):
    df = QUERIES["op8_chat_format"](spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString()
    forged = df.where("conv_id = -7").first()
    assert forged["n_turns"] == 2 and forged["loss_chars"] == len("</s>[INST] ok [/INST]")


