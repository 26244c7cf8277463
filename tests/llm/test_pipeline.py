"""Each stage of the pipeline, and the whole of it, against brute force on small tables."""

import numpy as np
import pytest

import corpus_pipeline as cp
from fluxmill.llm import fmindex, queries

WORDS = {"en": "the of and that with from were been this have", "de": "der und nicht auch sich mit eine wird oder nach", "fr": "le que pour dans est une avec plus sur pas"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _hash string, _id string"


def corpus():
    rng = np.random.default_rng(11)
    sentence = lambda lang, n: " ".join(rng.choice(WORDS[lang].split(), n)) + f" {rng.integers(10**9)}"
    rows = []
    for k in range(90):
        lang = list(WORDS)[k % 3]
        rows.append((k, "\n".join(sentence(lang, 14) for _ in range(5)), lang if k % 7 else None))
    rows[10] = (10, rows[9][1], "en")  # an exact copy
    rows[12] = (12, rows[11][1].replace("\n", " ") + " tail", "en")  # a near copy on one line
    rows[20] = (20, rows[20][1] + "\n" + " ".join(f"bench{j}" for j in range(14)) + " after", "en")
    rows[25] = (25, rows[24][1].split("\n")[1] + "\nan own line of twenty-five", "de")
    rows += [(None, rows[3][1].split("\n")[0] + "\nan own line without an id", "en"), (None, "another line, which is longer, also without an id", "en"), (7, "a second text of seven, all its own", "en"), (91, None, "en"), (92, "", "en"), (93, "1234 !!", None), (94, " \n ", "en")]
    return [(i, t, lang, "s", None if t is None else len(t), "r", "h", "i") for i, t, lang in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    bench = " ".join(f"bench{j}" for j in range(14))
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs


def key(rows):
    return sorted(str(tuple(r)) for r in rows)


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return a == b or any(a[k + (len(a) == len(b)) :] == b[k + 1 :] and a[:k] == b[:k] for k in range(len(b)))


def lines_by_hand(rows):
    """Lines that no earlier one equals, or is within an edit of from 16 characters on; null ids come last."""
    places = sorted((r[0] is None, r[0] or 0, k, line) for r in rows if r[1] is not None for k, line in enumerate(r[1].split("\n")))
    seen, gone = [], set()
    for absent, doc, k, line in sorted(set(places)):
        if not line.strip():
            continue
        if any(s == line or min(len(s), len(line)) >= 16 and within_one_edit(s, line) for s in seen):
            gone.add((absent, doc, k, line))
        seen.append(line)
    out = []
    for i, t, lang, source, _, *rest in rows:
        if t is None:
            out.append((i, t, lang, source, None, *rest))
            continue
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if (i is None, i or 0, k, x) not in gone]
        new = "\n".join(left)
        if len(left) == len(lines) or new.strip():
            out.append((i, new, lang, source, len(new), *rest))
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_by_hand(rows):
    by = {}
    for r in rows:
        if r[0] is not None:
            by.setdefault(r[0], []).append(shingles(r[1]))
    root = {i: i for i in by}
    linked = [(a, b) for a in by for b in by if a < b and any(x and y and len(x & y) >= 0.8 * len(x | y) for x in by[a] for y in by[b])]
    for _ in by:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if r[0] is None or root[r[0]] == r[0] or not any(by[r[0]])]


def windows(text, n=10):
    w = fmindex.words_of((text or "").encode())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_language_stage(spark, tables):
    d, docs = tables
    out = cp.language_id(spark, docs, d)
    assert out.columns == docs.columns
    got = out.collect()
    want = [r for r in corpus() if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str(r[:2]) for r in want)
    told = {r["doc_id"]: r["lang"] for r in got}
    assert all(told[k] == list(WORDS)[k % 3] for k in range(0, 90, 7) if k != 7)
    assert cp.language_id(spark, docs.limit(0), d).count() == 0


def test_line_stage(spark, tables):
    d, docs = tables
    out = cp.line_dedup(spark, docs, d)
    assert out.columns == docs.columns and key(out.collect()) == key(lines_by_hand(corpus()))
    plain = docs.drop("n_chars")
    assert cp.line_dedup(spark, plain, d).columns == plain.columns
    assert cp.line_dedup(spark, docs.limit(0), d).count() == 0


def test_near_stage(spark, tables):
    d, docs = tables
    out = cp.near_dedup(spark, docs, d)
    assert out.columns == docs.columns and key(out.collect()) == key(near_by_hand(corpus()))
    assert cp.near_dedup(spark, docs.limit(0), d).count() == 0


def test_decontamination_stage(spark, tables):
    d, docs = tables
    out = cp.decontamination(spark, docs, d)
    bench = windows(" ".join(f"bench{j}" for j in range(14)))
    want = [r for r in corpus() if not windows(r[1]) & bench]
    assert len(want) == len(corpus()) - 1
    assert out.columns == docs.columns and key(out.collect()) == key(want)
    assert cp.decontamination(spark, docs.limit(0), d).count() == 0


def test_run_is_its_stages(spark, tables):
    from tokenizers import Tokenizer

    d, docs = tables
    want = [r for r in corpus() if r[1] and any(c.isalpha() for c in r[1])]
    bench = windows(" ".join(f"bench{j}" for j in range(14)))
    want = [r for r in near_by_hand(lines_by_hand(want)) if not windows(r[1]) & bench]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = sorted((str(r[0]), np.array([*tok.encode(r[1], add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in want)
    rows = cp.run(spark, d).collect()
    by = {}
    for r in rows:
        by.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    one_each = {k: b"".join(x for _, x in sorted(v)) for k, v in by.items()}
    assert sum(len(x) for x in one_each.values()) == sum(len(x) for _, x in ids)
    assert sorted((k[0], v) for k, v in one_each.items()) == ids
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0 and sum(n for _, n in pieces) <= 2048
