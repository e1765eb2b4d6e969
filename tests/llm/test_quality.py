"""Quality rules against brute force; host verdicts."""

import random
import re

from tidelog.llm.quality import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def texts():
    rng = random.Random(8)
    parts = ["a", "b", "é", "##", "x|y", " ", "\x1c", "word"]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "\n\n"]
    out = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "one " * 30, "w " * 30_000, "\n".join(["same line here"] * 4), "🎉 é 日本 " * 9]
    return out + ["".join(rng.choice(parts[: rng.randint(2, 8)]) + rng.choice(gaps) for _ in range(rng.randint(0, 80))) for _ in range(300)]


def test_metrics_as_brute_force(spark):
    rows = [(i if i % 7 else None, t, None if i % 5 == 0 else f"s{i % 4}", "clash", 3) for i, t in enumerate(texts())]
    rows.append(rows[9])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words int")
    got = quality_rules(spark, docs, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), repr(r.text)[:200]


def test_hosts_that_fail_go_with_all_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad" if i < 400 and i % 50 else good, "spam" if i < 400 else "fine") for i in range(800)]
    rows += [(1000, "bad", "small"), (1001, good, None)]
    got = {r.doc_id: r for r in quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert got[0].host_failed and not got[0].base_failed and not got[0].kept
    assert got[500].kept and got[1001].kept
    assert not got[1000].host_failed, "one bad document is no evidence"


def test_main_path_is_native_and_empty_tables_work(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    found = quality_rules(spark, docs, ["doc_id"])
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 0 and not re.search("Python|Pandas|Arrow", plan)
