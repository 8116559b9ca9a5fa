"""Operators on lines, byte strings, benchmark items and tool calls, and the pipeline."""

import hashlib
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidar.llm import catalog, chat, decontam, lines, packing, substrings
from tests.llm.brute_repeats import brute
from tests.llm.data import docs, empty, prose

SF = "/root/testdata/sf0.01"


# ---- lines -------------------------------------------------------------------------
def remove_later_runs(rows, least):
    """Longest earlier match at every line, by comparing all places; rows equal in id and text are one place."""
    places = sorted({(i is not None, i or 0, t) for i, t in rows})
    seqs = {p: [(k, x) for k, x in enumerate((p[2] or "").split("\n")) if x.split()] for p in places}
    gone = {p: set() for p in places}
    flat = [(n, s) for n, p in enumerate(places) for s in range(len(seqs[p]))]
    for n, s in flat:
        mine = seqs[places[n]]
        for m, r in flat:
            if (m, r) >= (n, s):
                break
            other, size = seqs[places[m]], 0
            while s + size < len(mine) and r + size < len(other) and mine[s + size][1] == other[r + size][1]:
                size += 1
            if sum(len(x.split()) for _, x in mine[s : s + size]) >= least:
                gone[places[n]] |= {mine[s + k][0] for k in range(size)}
    out = []
    for i, t in rows:
        cut = gone[i is not None, i or 0, t]
        out.append((str(i), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in cut) if cut else t, len(cut)))
    return sorted(out, key=str)


def test_line_runs_equal_brute_force(spark):
    a, b, c = prose(1, 7), prose(2, 2), "one two"
    texts = [f"{a}\n{b}\n\n{c}\nx", f"{b}\n{c}\nq\n{a}", f"{c}\n{b}", f"{b}\n{c}\n{b}\n{c}\nx", "", a, f"{a}\n{a}\n{a}", "w\nw\nw\nw\nw\nw\nw\nw", f"\n \n{a} \n{a}"]
    rows = list(enumerate(texts)) + [(None, a), (5, a), (5, b + "\n" + c), (3, texts[0])]
    got = lines.remove_lines(docs(spark, rows, clashes=True), 5)
    assert got.columns == [*docs(spark, rows, clashes=True).columns, "_n_lines", "_n_removed"]
    # Brute force orders equal ids by text, the operator by a hash of the text; ids with two texts share no line run here but the first.
    distinct = [r for r in rows if r[0] not in (3, 5)]
    found = lines.remove_lines(docs(spark, distinct), 5).collect()
    assert sorted(((str(r["doc_id"]), r["text"], r["_n_removed"]) for r in found), key=str) == remove_later_runs(distinct, 5)
    nulls = lines.remove_lines(docs(spark, [(1, None), (2, None)])).collect()
    assert [(r["text"], r["_n_lines"], r["_n_removed"]) for r in nulls] == [(None, 0, 0)] * 2
    assert lines.remove_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = catalog.QUERIES[name](spark, SF).toArrow()
    want = db.execute(catalog.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert sorted(map(str, got.select(columns).to_pylist())) == sorted(map(str, want.select(columns).to_pylist()))


# ---- byte strings ------------------------------------------------------------------
def test_repeated_strings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 1 << 11)
    size = 80
    base = prose(1, 300)
    texts = [
        base, base[:700] + "X" + base[700:], prose(2, 60) + base[100:400], prose(3, 50), prose(4, 30) + "é" * 100 + prose(5, 30), "é" * 100 + prose(6, 9),
        "ab" * 150, "a" * 200, None, "", "short", prose(7, 40) + base[150 : 150 + size] + prose(8, 40), base[5:85], "z" * size, prose(9, 1200),
    ]
    rows = list(enumerate(texts)) + [(None, base), (3, prose(3, 50)), (3, prose(10, 60))]
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in data:
        for s in range(len(b) - size + 1):
            seen[b[s : s + size]] = seen.get(b[s : s + size], 0) + 1
    want = []
    for (i, _), b in zip(rows, data):
        cut = [False] * len(b)
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                cut[s : s + size] = [True] * size
        spans = sum(x and not (k and cut[k - 1]) for k, x in enumerate(cut))
        kept = bytes(c for c, x in zip(b, cut) if not x)
        want.append((str(i), len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = substrings.remove_repeats(docs(spark, rows, clashes=True), size).collect()
    assert sorted((str(r[0]), *r[1:5], bytes(r[5])) for r in got) == sorted(want)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    passage, brief = prose(20, 60), prose(21, 60, ("a", "of"))
    assert len(brief) + 2 < 400 <= len(passage)
    planted = [f"{passage} {prose(30, 80)}", f"{prose(31, 80)} {passage} {prose(32, 9)}é", f"É{prose(33, 80)} {passage}", passage]
    clean = [prose(34, 80), f"{prose(35, 90)}é", f"{prose(36, 80)} {brief} {prose(37, 9)}", f"{brief} {prose(38, 80)}", ""]
    texts = planted + clean
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in substrings.op10_repeated_substrings(spark, str(tmp_path)).collect()}
    want = brute([t.encode() for t in texts])
    assert [tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for k in range(len(texts))] == want
    assert all(got[k]["n_removed"] >= len(passage) for k in range(len(planted)))
    assert all(got[k]["n_removed"] == 0 for k in range(len(planted), len(texts)))


# ---- benchmark ---------------------------------------------------------------------
def test_re_parameterised_questions(spark):
    items = [
        (1, "A train travels 60 km in 2 hours with Anna aboard, how far does it go in 60 hours?"), (2, "too short"), (3, None),
        (4, "alpha beta gamma delta epsilon"), (5, "plain words only in this item without any value at all"),
    ]
    texts = [
        "Intro. A train travels 75 km in 3 hours with Maria aboard, how far does it go in 75 hours? End.",  # 60 -> 75 twice
        "A train travels 75 km in 3 hours with Maria aboard, how far does it go in 99 hours?",  # 60 -> 75 and 99
        "x alpha beta gamma delta epsilon y", "alpha beta gamma delta", "Plain words ONLY in this item, without any value at all", None, "", "1 2 3 4 5 6 7 8 9",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[2])]
    got = decontam.leaks(docs(spark, rows, clashes=True), bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["exact"]) for r in got) == [("0", 1, False), ("2", 4, True), ("4", 5, True), ("None", 4, True)]
    kept = decontam.decontaminated(docs(spark, rows, clashes=True), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(docs(spark, texts), bench.where("false")).count() == 0


# ---- tool calls --------------------------------------------------------------------
def test_tool_calls(spark):
    calls = [
        ("c", "a", None, "f", '{"b": 2, "a": "x\\n\\"é"}'), ("c", "b", "a", "f", '{"a": 1}'), ("c", "d", "b", "f", "not json"), ("c", "e", "gone", "f", "[1]"),
        ("c", "p", "q", "f", '{"a": "s", "b": 1.5}'), ("c", "q", "p", "f", None), ("c", "b", "a", "f", '{"a": 2}'), ("k", "a", None, "f", '{"a": "", "b": null}'),
        (None, "a", None, "f", "{}"), ("c", None, None, "f", "{}"), ("c", "s", "s", "f", '{"a": "t"}'),
    ]
    results = [("c", "a", "done"), ("c", "zz", "alone"), ("k", "a", None), ("c", "d", "r1"), ("c", "d", "r0"), (None, None, "r")]
    schema = {"a": "string", "b": "integer"}
    call_df = spark.createDataFrame(calls, "conv_id string, call_id string, parent_id string, name string, arguments string")
    result_df = spark.createDataFrame(results, "conv_id string, call_id string, content string")
    got = chat.link_calls(call_df, result_df, schema, ("a",)).collect()
    by = {}
    for r in got:
        by.setdefault((r["conv_id"], r["call_id"], r["status"]), []).append(r)
    assert len(got) == len(calls) + len(results) - 3  # three linked pairs
    first = by["c", "a", "linked"][0]
    assert json.loads(first["json"]) == {"arguments": {"a": 'x\n"é', "b": 2}, "id": "a", "name": "f", "parent": None, "result": "done"}
    assert first["json"] == json.dumps(json.loads(first["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert [by["c", n, s][0]["depth"] for n, s in (("a", "linked"), ("b", "unanswered"), ("d", "linked"), ("e", "unanswered"))] == [0, 1, 2, 0]
    assert {n: by["c", n, s][0]["faults"] for n, s in (("a", "linked"), ("b", "unanswered"), ("d", "linked"), ("e", "unanswered"), ("p", "cycle"))} == {
        "a": "", "b": "a", "d": "arguments", "e": "arguments", "p": "b"}
    assert by["c", "q", "cycle"] and by["c", "s", "cycle"] and by["c", "zz", "orphan"] and by["k", "a", "linked"][0]["faults"] == ""
    assert len(by["c", "b", "repeated"]) == 1 and len(by["c", "d", "repeated"]) == 1 and len(by[None, "a", "unnamed"]) == 1
    nothing = chat.link_calls(call_df.where("false"), result_df.where("false"), schema, ())
    assert nothing.count() == 0


def test_tool_calls_of_awkward_turns_equal_sql(spark, tmp_path):
    turns = [(7, t, ("system", "user", "assistant")[t % 3], f"t{t} \"é\"\n\\") for t in range(40)]  # a system turn between all exchanges
    turns += [(8, 0, "user", "a"), (8, 0, "user", "b"), (8, 1, "assistant", None), (8, 1, "assistant", "x"), (8, 5, "user", None), (8, 9, None, "who")]
    turns += [(9, None, "user", "no place"), (None, 1, "user", "no conversation"), (9, None, "assistant", ""), (9, 3, "assistant", "alone"), (9, None, "system", "s")]
    turns += [(10, 2, "user", "same")] * 2 + [(10, 4, "tool", "other role")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("_n", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op5_tool_calls(spark, str(tmp_path)).toArrow()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = db.execute(chat.OP5_SQL).to_arrow_table().select(got.column_names)
    assert sorted(map(str, got.to_pylist())) == sorted(map(str, want.to_pylist()))
    rows = {(r["conv_id"], r["call_id"]): r for r in got.to_pylist()}
    assert (rows[7, "7:4"]["parent_id"], rows[7, "7:4"]["depth"], rows[7, "7:4"]["status"]) == ("7:1", 1, "linked")
    assert rows[7, "7:3"]["status"] == "message" and rows[8, "8:5"]["faults"] == "text"


# ---- pipeline ----------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    passage = prose(50, 60)
    texts = [prose(k, 40) for k in range(12)] + [None, "", "12 34", prose(3, 40), prose(40, 30) + "\n" + passage, prose(41, 30) + "\n" + passage, "A " + prose(60, 30)]
    table = docs(spark, texts)
    table.coalesce(1).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame([(1, prose(60, 30))], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "pack":
            assert now.columns == table.columns
            kept[name] = {r["doc_id"]: r for r in now.collect()}
    assert set(kept["language_id"]) == {*range(12), 15, 16, 17, 18}
    assert kept["line_dedup"][17]["text"] == prose(41, 30) and kept["line_dedup"][17]["n_chars"] == len(prose(41, 30))
    assert kept["line_dedup"][16]["text"] == texts[16] and kept["line_dedup"][15]["text"] == ""
    assert set(kept["near_dedup"]) == set(kept["line_dedup"])
    assert set(kept["decontaminate"]) == set(kept["near_dedup"]) - {18}
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(kept["decontaminate"])
    nothing = docs(spark, ["abc", None, "12"], clashes=True).withColumn("lang", F.lit(None).cast("string"))
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, nothing, "").collect()] == [0]
    assert packing.plan({}, 10)["length"].size == 0


def test_language_stage_decides(spark):
    texts = [(k, prose(k, 200)) for k in range(30)] + [(90, "Ωραία μέρα για μια βόλτα στη θάλασσα"), (91, "q9 Zx"), (92, prose(92, 60)), (93, prose(93, 60)), (94, "12345")]
    table = docs(spark, texts, clashes=True).withColumn("_lang", F.lit("x")).withColumn("cost", F.lit(1)).withColumn("row", F.lit(2))
    lang = F.when(F.col("doc_id") == 92, None).when(F.col("doc_id") == 93, "xx").when(F.col("doc_id") >= 90, None).otherwise("en")
    table = table.withColumn("lang", lang)
    kept = corpus_pipeline.language_id(spark, table, "")
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == table.columns and set(rows) == {*range(30), 91, 92, 93}
    assert rows[92]["lang"] == "en" and rows[92]["_lang"] == "x"
    assert corpus_pipeline.language_id(spark, empty(spark), "").count() == 0
