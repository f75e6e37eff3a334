"""Quality rules against a plain Python count of every statistic, and the trees' constraints."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cadence.llm import quality
from cadence.llm.common import table, text_slices
from cadence.llm.gbt import train

SF = "/root/testdata/sf0.001"


def plain(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if wins[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def made(rng: random.Random, n: int) -> list[str | None]:
    alphabet = ["a", "b", "é", "漢", "#", "|", " ", " ", "\n", "\t", "\x0b", "\x85", " ", "😀"]
    out: list[str | None] = [None, "", " ", "\n", "\n\n a", "a\n", "a\na\n", "a\r\na", "x " * 40, "\na\n\na"]
    for _ in range(n):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
        out.append(s * rng.choice([1, 1, 2, 3]))
    return out


def test_statistics_match_plain_counts_whatever_the_slices():
    texts = made(random.Random(5), 400)
    for size in (1, 200, 1 << 20):
        got = np.concatenate([quality.statistics(t)[0] for t in text_slices(pa.array(texts, pa.string()), size)])
        assert [tuple(r) for r in got.tolist()] == [plain(t) for t in texts]


def test_monotone_constraints_hold():
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(600) > 0.6).astype(float)
    t = train(x, y, [1, 0, -1])
    grid = np.repeat(rng.random((50, 3)), 40, axis=0)
    for f, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(t.score(g).reshape(50, 40), axis=1) >= -1e-12).all()
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_report_on_whole_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    said = {r.doc_id: r.quality for r in labels.collect()}
    right = []
    for r in docs.collect():
        g = got[r.doc_id]
        counts = plain(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == counts
        assert g.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (g.base_failed and g.kept)
        if r.doc_id in said and not g.base_failed:
            right.append(g.kept == (said[r.doc_id] == 1))
    assert len(got) == docs.count() and sum(right) >= 0.95 * len(right)


def test_defined_cases(spark):
    schema = "doc_id long, text string, kept string, score double, `a.b` int"
    rows = [(1, None, "x", 1.0, 1), (None, "", "y", None, 2), (2, "word " * 5, None, 0.5, 3), (2, "one two three four five " * 4, "z", 0.1, None)]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.report(docs, none).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got) == [(0, True, False), (0, True, False), (5, True, False), (20, True, False)]
    odd = spark.createDataFrame([(2, None, 0), (None, 1, 0), (2, 1, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.kept_documents(docs, odd).count() == 0
    assert quality.kept_documents(docs, odd).columns == docs.columns
    assert quality.report(docs.limit(0), odd).count() == 0


def test_repeated_identifiers_teach_once(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice("the of and a in to it is was for".split()) + "," for _ in range(60)) for _ in range(40)]
    junk = ["| # " * 5 + " ".join(rng.choice("AB CD EF GH !!".split()) for _ in range(60)) for _ in range(40)]
    once = [(i, x) for i, x in enumerate([*good, *junk])]
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i, _ in once], "doc_id long, quality int, toxic int")
    grid = np.random.default_rng(1).random((300, len(quality.FEATURES))) * 4
    want = quality.fit(spark.createDataFrame(once, "doc_id long, text string"), labels, sample=80)
    assert len(want.root) and len(set(want.score(grid))) > 1
    hot = [once[0]] * 400  # one identifier with most rows
    three = once * 3  # three copies of each row
    odd = [(0, "| # " + "ZZ !! " * 40)] * 3  # other texts under the same identifier: one of them teaches, whatever the order
    for rows in (once + hot, three):
        got = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=80)
        assert (got.score(grid) == want.score(grid)).all()
    a, b = (quality.fit(spark.createDataFrame(x, "doc_id long, text string"), labels, sample=80).score(grid) for x in (once + odd, odd + once[::-1]))
    assert (a == b).all()
