"""The training-corpus operators against brute force, and on awkward tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxmill.llm import compaction, fmindex, htmltext, language, linedup, membership, minmax, packing, pivots, queries, scratch, toxicity, urlrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, bucket string, spans string"


def awkward(spark, extra=()):
    long_ = " ".join(f"word{k}" for k in range(30_000))
    texts = [(1, "One two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "  \n \t"), (6, long_), (7, long_ + " end"), (8, "a"), (9, "12 34 !!"), (None, "one two three four five six"), (10, "ünïcode wörds höre"), *extra]
    return spark.createDataFrame([(i, t, None, None, None, "r", "n", "b", "s") for i, t in texts], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def components(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    docs = awkward(spark, [(20, "don't we'll  <|endoftext|> İstanbul ΣΑΣ\u0301 x\u00a0y"), (21, "tab\tand\r\nline " * 50)])
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    by = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in {(r["doc_id"], r["text"]) for r in docs.collect()} - {(2, "one two three four five six")}:
        want = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(p["ids"] for p in sorted(by[doc_id], key=lambda p: p["start"])) == want
    assert len(by[2]) == 2  # repeated rows are separate documents
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_examples_keep_all_three_limits(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(n), int(n * f)) for k, (n, f) in enumerate(zip(rng.integers(1, 300, 400), rng.uniform(0, 1, 400), strict=True))]
    df = spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long")
    limits = packing.Limits(tokens=1000, segments=8, loss=500, pool=64)
    size = {k: (n, x) for k, n, x in rows}
    seqs = {}
    for r in packing.pack_examples(df, limits).collect():
        seqs.setdefault(r["sequence_id"], []).append(r["example_id"])
    assert sorted(x for s in seqs.values() for x in s) == list(range(400))
    for s in seqs.values():
        assert sum(size[x][0] for x in s) <= 1000 and len(s) <= 8 and sum(size[x][1] for x in s) <= 500
    with pytest.raises(Exception, match="exceeds a sequence"):
        packing.pack_examples(spark.createDataFrame([(1, 2000, 0)], df.schema), limits).collect()


def near_copies(seed=5, n=260):
    """One family of near copies with 0 to 12 words changed, and its exact copies."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10_000, 90)]
    out = [" ".join(base)] * 3
    for k in range(n):
        words = list(base)
        for at in rng.choice(90, rng.integers(0, 13), replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("rare", [8, 64])
def test_near_duplicates_match_all_pairs(spark, rare):
    texts = [(100 + k, t) for k, t in enumerate(near_copies())]
    docs = awkward(spark, texts)
    got = {r["doc_id"]: r for r in minmax.near_duplicates(docs, minmax.MinMaxParams(rare=rare)).collect()}
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    for i, s in sets.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), want[i], want[i] == i)
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert minmax.near_duplicates(empty(spark)).count() == 0


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdé 😀"), 24)) for _ in range(30)]
    texts = []
    for k in range(60):
        lines = []
        for line in rng.choice(base, 4):
            at, how = int(rng.integers(0, 24)), rng.integers(0, 5)
            lines.append([line, line[:at] + line[at + 1 :], line[:at] + "z" + line[at:], line[:at] + "q" + line[at + 1 :], line[::-1]][how])
        texts.append((50 + k, "\n".join([*lines, "", "short", "shorts"])))
    docs = awkward(spark, texts)
    got = {(r["doc_id"], r["line_no"]): r for r in linedup.line_decisions(docs).collect()}
    lines = sorted({(r["doc_id"] is None, r["doc_id"] or 0, k, line) for r in docs.collect() if r["text"] is not None for k, line in enumerate(r["text"].split("\n"))})
    seen = []
    for absent, doc, k, line in lines:
        r = got[None if absent else doc, k]
        if not line.strip():
            assert r["kept"]
            continue
        dup = any(line == s or (min(len(line), len(s)) >= 16 and len(line) >= 16 and within_one_edit(line, s)) for s in seen)
        assert r["kept"] == (not dup), (doc, k, line)
        seen.append(line)
    clean = {r["doc_id"]: r for r in linedup.without_repeated_lines(docs).collect()}
    assert len(clean[50]["text"].split("\n")) == 7 - clean[50]["n_lines_dropped"]
    assert clean[3]["text"] is None
    assert linedup.line_decisions(empty(spark)).count() == 0


def test_rows_without_an_id_keep_their_own_lines(spark):
    line = "a repeated line of text"
    rows = [(1, line), (None, "a repeated line of text\nremains here"), (None, "a line that nobody else has"), (7, "its first line"), (7, "stays"), (7, line), (7, None)]
    got = linedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, rows[0][1], 0), (None, "remains here", 1), (None, rows[2][1], 0), (7, "its first line", 0), (7, "stays", 0), (7, "", 1), (7, None, 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary, 14))) for k in range(20)] + [(90, "V1, v2-v3"), (91, None), (92, "?!"), (90, "v1 v2 v3")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    texts = []
    for k in range(40):
        words = list(rng.choice([*vocabulary, "zz", "Other"], 60))
        if k % 3 == 0:
            words[20:34] = items[k % 20][1].split()
        texts.append((50 + k, ", ".join(words)))
    docs = awkward(spark, texts)

    def windows(words):
        n = min(10, len(words))
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()

    per_item = {}
    for i, t in items:
        per_item.setdefault(i, set()).update(windows([w.decode() for w in fmindex.words_of(t.encode() if t else None)]))
    for block in (fmindex.BLOCK_BYTES, 200):
        found = fmindex.find_leaks(docs, bench, shard_words=300, block_bytes=block)
        got = {r["doc_id"]: r for r in fmindex.leak_digest(found).collect()}
        assert found.count() == docs.count()
        for r in docs.collect():
            words = [w.decode() for w in fmindex.words_of(r["text"].encode() if r["text"] else None)] if len(r["text"] or "") < 10_000 else None
            if words is None:
                continue
            hit, named = set(), set()
            for i, ws in per_item.items():
                for w in ws:
                    for k in range(len(words) - len(w) + 1):
                        if tuple(words[k : k + len(w)]) == w:
                            hit.update(range(k, k + len(w)))
                            named.add(i)
            g = got[r["doc_id"]]
            digest = hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()
            assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (len(words), len(hit), len(named), digest, bool(hit))
    carried = fmindex.find_leaks(docs, bench, carry=True).select("row.*")
    assert carried.columns == docs.columns and carried.count() == docs.count()
    assert fmindex.find_leaks(empty(spark), bench).count() == 0
    assert fmindex.find_leaks(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert fmindex.cut_spans("A b, c d", [[1, 3]]) == "A  d"


def test_fm_index_locates_all(spark):
    text = np.array([1, 2, 1, 2, 1, 3, 0, 2, 1, 2, 0] * 3)
    index = fmindex.FMIndex(text, 3, sample=4)
    lo, hi = index.search(np.array([[1, 2], [2, 1], [3, 3]]))
    for k, (a, b) in enumerate(((1, 2), (2, 1), (3, 3))):
        want = [i for i in range(len(text) - 1) if text[i] == a and text[i + 1] == b]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = [(k, (base[k % 12] + rng.normal(0, 0.14, 16)).tolist()) for k in range(300)]
    rows += [(400, rows[0][1]), (401, [0.0] * 16), (402, None), (403, [float("nan")] * 16), (404, [None] * 16), (405, [1.0]), (406, [])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, node string, name string")
    got = {r["vec_id"]: r for r in pivots.near_vectors(df, cell=40, block=16).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 401}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    want = components([i for i, _ in rows], links)
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in x for x in links), want[i], want[i] == i)
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/x?q", "http://x.net/es/1", "http://x.net/de/", "http://foo.com", "nothing", None, "http://com/", "x://notexample.com/en/#f"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, queries.URL_RULES, none).orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("x.net", "/es/1", "net/es/", "block"),
        ("x.net", "/de/", None, "allow"), ("foo.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/", "com/", "allow"), ("notexample.com", "/en/", "com/", "allow"),
    ]
    bad = [(f"http://a{k}.org/{'casino' if k % 2 else 'news'}/{'win' if k % 4 == 1 else 'tip'}", k % 4 == 1) for k in range(200)]
    mined = urlrules.mine_rules(spark.createDataFrame(bad, "url string, bad boolean"))
    assert ["win"] in [r["antecedent"] for r in mined.collect()]
    more = pages.select(F.col("page_id"), F.when(F.col("page_id") == 3, "http://x.org/win/casino").otherwise(F.col("url")).alias("url"))
    for inline in (2000, 0):
        v = {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(more, queries.URL_RULES, mined, urlrules.UrlParams(inline_rules=inline)).collect()}
        assert v[3] == "block" and v[5] == "allow" and len(v) == 9
    assert urlrules.mine_rules(spark.createDataFrame([], "url string, bad boolean")).count() == 0


def test_url_rules_use_every_frequent_token(spark):
    rows = [(f"http://x/w{k}/{n}", True) for k in range(30) for n in range(20)]
    rows += [(f"http://x/lucky/draw/{n}", True) for n in range(20)]  # good alone, bad together
    rows += [(f"http://x/{t}/{n}", False) for t in ("lucky", "draw") for n in range(200)]
    mined = [r["antecedent"] for r in urlrules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()]
    assert ["draw", "lucky"] in mined and all([f"w{k}"] in mined for k in range(30))


def test_shards_round_trip_and_commits(spark, tmp_path):
    docs = awkward(spark)
    store = compaction.compact_arrivals(docs, f"file://{tmp_path}/a", params=compaction.TierParams(target_bytes=1 << 20, smallest_bytes=1 << 10, fanout=2))
    back = store.read()
    key = lambda df: sorted(str(tuple(r)) for r in df.select("doc_id", "text", "row").collect())
    assert key(back) == key(docs) and back.filter("shard is null").count() == 0
    base = store.manifest()
    assert base.version >= 5 and len(base.runs(store.params)) < 4 and store.versions() == [base.version]
    store.append(docs.limit(1))
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(base, [])
    assert store.read(base.version).count() == docs.count() and store.read().count() == docs.count() + 1
    with pytest.raises(ValueError, match="no version"):
        store.read(base.version - 1)
    none = compaction.compact_arrivals(empty(spark), f"file://{tmp_path}/b")
    assert none.read().count() == 0 and none.read().columns == [*docs.columns, "shard"]


def test_runs_of_a_tier_are_merged_and_others_left(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/c", compaction.TierParams(target_bytes=1 << 22, smallest_bytes=1 << 12, fanout=3))
    rows = lambda lo, n: spark.range(lo, lo + n, 1, 4).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text")
    store.append(rows(0, 20_000))  # four files are one run: alone in its tier, it stays
    large = {s["path"] for s in store.compact().shards}
    assert len(large) == 4
    for k in range(1, 4):
        store.append(rows(100_000 * k, 10))
        store.compact()
    m = store.manifest()
    assert large < {s["path"] for s in m.shards} and len(m.runs(store.params)) == 2
    assert store.read().count() == 20_030


def test_shards_keep_clashing_and_late_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 7, 8), (None, None, None, None)], "doc_id long, text string, _arrival int, shard int")
    store = compaction.compact_arrivals(docs, f"file://{tmp_path}/d")
    back = store.read()
    assert back.columns == ["doc_id", "text", "_arrival", "shard", "shard_1"]
    assert sorted(map(str, back.drop("shard_1").collect())) == sorted(map(str, docs.collect()))
    store.append(spark.createDataFrame([(2, "late")], "doc_id long, extra string"))
    assert {r["doc_id"]: (r["text"], r["extra"]) for r in store.read().collect()} == {1: ("a", None), None: (None, None), 2: (None, "late")}
    with pytest.raises(ValueError, match="column text"):
        store.append(spark.createDataFrame([(2, 5)], "doc_id long, text int"))


def test_toxicity_finds_the_interaction(spark):
    rng = np.random.default_rng(6)
    filler = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(1200):
        words = list(rng.choice(filler, 30))
        a, b = k % 2, (k // 2) % 2
        words += ["insultx"] * a + ["groupy"] * b
        rows.append((k, " ".join(words), a * b))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, machine).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    scored = toxicity.score_toxicity(awkward(spark), machine)
    assert scored.count() == 12 and scored.filter("score is null or score < 0 or score > 1").count() == 0
    nothing = toxicity.fit_toxicity(empty(spark), labels)
    assert toxicity.score_toxicity(awkward(spark), nothing).filter("score = 0.5").count() == 12


def test_language(spark):
    words = {"en": "the of and that with from", "de": "der und nicht auch sich mit", "fr": "le que pour dans est une", "es": "el los para con por una", "fi": "ja on ei se hän oli"}
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(rng.choice(words[lang].split(), 25)), lang) for k, lang in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs.filter("doc_id % 3 > 0"))
    got = language.predict_language(docs, model).filter("doc_id % 3 = 0").join(docs, "doc_id")
    assert got.filter("lang_pred <> lang").count() == 0 and set(model.pair_svms) == {"germanic", "romance"}
    odd = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(awkward(spark), model).collect()}
    assert {i for i, x in odd.items() if x == "und"} == {3, 4, 5, 9} and odd[6] in words
    assert language.predict_language(docs, language.fit_language(empty(spark))).filter("lang_pred = 'und'").count() == len(rows)
    carried = language.predict_language(awkward(spark), model, carry=True)
    assert carried.select("row.*").columns == awkward(spark).columns and carried.count() == 12


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>One<p>two <b>bold</b>text", "One\n\ntwo boldtext"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>after", "- a\n- b\n  1. c\n\nafter"),
        ("<table><tr><th>Name<th>N<tr><td>Ann<td>10<tr><td>Bo<td>7</table>", "Name  N\nAnn   10\nBo    7"),
        ("<head><title>t</title></head>x<script>var a='<p>'</script><style>p{}</style><div hidden>h</div><div style='display: none'>n</div><span>y", "xy"),
        ("a<br>b &amp; &lt;c&gt;<!-- no -->", "a\nb & <c>"),
        ("<pre>x\n  y</pre>", "x\n  y"),
        ("<div>a</div></p></b><div>b", "a\nb"),
        ("", ""),
        (None, ""),
        ("<script>only", ""),
    ],
)
def test_rendering(source, want):
    assert htmltext.render(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<table><thead><th>Name<th>Age</thead><tbody><td>Ann<td>10<tr><td>Bo<td>7</table>", "Name  Age\nAnn   10\nBo    7"),
        ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><tbody><form><tr><td>a<td>b</tr><tr><td>c</tr></form></tbody></table>", "a  b\nc"),
        ("<table><tbody><form><td>a<td>b</form></table>", "a  b"),
        ("<table><tbody>text<div>more</div><tr><td>a</table>", "text\nmore\na"),
        ("<table><tbody hidden><td>x</tbody><tbody><td>y</table>", "y"),
    ],
)
def test_rows_are_implied_and_nothing_in_a_row_group_is_lost(source, want):
    assert htmltext.render(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
        ("<textarea>\nx\n  &lt;y</textarea>z", "x\n  <y\nz"),
        ("<dialog>shut</dialog><dialog open>seen</dialog>", "seen"),
    ],
)
def test_formulas_text_areas_and_open_dialogs_are_seen(source, want):
    assert htmltext.render(source) == want


def test_deep_pages_and_empty_tables(spark):
    assert htmltext.render("<div>" * 20_000 + "x") == "x"
    df = spark.createDataFrame([(1, None), (1, "<p>a"), (None, "<p>a</p><p>b")], "page_id long, html string")
    assert sorted((r["text"], r["n_blocks"]) for r in htmltext.extract_text(df).collect()) == [("", 0), ("a", 1), ("a\n\nb", 2)]
    assert htmltext.extract_text(df.limit(0)).count() == 0


def test_scratch_reads_the_named_folder(spark):
    s = scratch.Scratch(spark, "t")
    assert s.save(spark.range(3), "x").count() == 3
    assert s.root.startswith(scratch.shared_dir(spark))


def test_html_is_read_in_linear_time_and_whole():
    for deep in ("<table><tr><td>" * 10_000, "<table><tr><td>a<td>" * 10_000, "<div>" * 100_000, "<p><table><tr><td>" + "<div>" * 50_000, "<ul><li>a" * 20_000):
        assert htmltext.render(deep + "x").endswith("x")
    assert htmltext.render("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>") == "A  B\n   C\nD  E"
    assert htmltext.render("<table><tr><td colspan=2 rowspan=0>A<td>B<tr><td>C<tr><td>D</table>") == "A    B\n     C\n     D"
    assert htmltext.render("x​y<pre>\n a\n\n b</pre>") == "x​y\n\n a\n\n b"
    assert htmltext.render("<select><option>one<option selected>two</select> <select><option>1<option>2</select> <select multiple><option>p<option>q</select>") == "two 1 p q"
    assert htmltext.render("<svg>no<g>no<text>yes</text></g><title>no</title></svg><dialog>no</dialog><dialog open>d</dialog><textarea>\n a</textarea>") == "yes\nd\n a"
    assert htmltext.render("<table><tr><td><h1>Title</h1><p>one<p>two</table>") == "Title\n\none\n\ntwo"


def test_encoder_forgets_and_falls_back():
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer.from_file(queries.tokenizer_path())
    plain = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    encode = packing.Encoder(tok)
    encode.LIMIT = 20
    texts = [" ".join(f"wörd{k % 37} o'clock{j} x\x02y \x02 {'z' * 80}" for k in range(30)) for j in range(12)] + ["", "  \n\t"]
    for _ in range(3):
        assert encode(texts) == [plain(t) for t in texts]
        assert len(encode.known) <= 20 and encode.by_word
    spaced = Tokenizer(models.WordLevel({"▁a": 0, "▁b": 1, "a": 2, "?": 3}, unk_token="?"))
    spaced.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="never")
    other = packing.Encoder(spaced)
    assert not other.by_word and other(["a b a"]) == [np.array(spaced.encode("a b a").ids, "<u4").tobytes()]


def test_near_copies_of_an_id_with_several_texts(spark):
    short, long_ = " ".join(f"s{k}" for k in range(20)), " ".join(f"t{k}" for k in range(200))
    rows = [(1, short), (1, long_), (2, short + " x"), (3, long_ + " x"), (4, "other words here")]
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_leaks_are_the_same_at_every_block_size(spark):
    leak, other = " ".join(f"b{k}" for k in range(12)), " ".join(f"c{k}" for k in range(12))
    bench = spark.createDataFrame([(1, leak), (2, other), (3, "short one"), (4, leak)], "item_id long, text string")
    rows = [(5, f"a {leak} z"), (5, "a " + "clean " * 13), (5, f"x {other} z"), (None, f"{leak} and {other}"), (None, "clean " * 26), (6, "a short one"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for block in (fmindex.BLOCK_BYTES, 100, 10):
        for carry in (False, True):
            found = fmindex.find_leaks(docs, bench, block_bytes=block, shard_words=20, carry=carry)
            got = sorted(str((r["doc_id"], r["n_words"], r["spans"], r["items"])) for r in found.collect())
            want = want or got
            assert got == want
    assert sorted(str((r[0], str(r[1]))) for r in found.select("row.*").collect()) == sorted(str((i, str(t))) for i, t in rows)
    assert sum("[]" not in x for x in want) == 4


def test_bits_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        ones = rng.random(n) < 0.3
        bits = fmindex.Bits(ones)
        assert bits.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(ones).tolist()]
        assert bits.get(np.arange(n)).tolist() == ones.tolist()


def test_long_texts_are_cut_of_lines_in_linear_time(spark):
    text = "\n".join(f"line number {k % 60_000} of a long text" for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "line number 5 of a long text\nmine")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linedup.without_repeated_lines(docs, linedup.LineParams(min_chars=1000)).collect()}
    assert got[1]["text"].split("\n") == text.split("\n")[:60_000] and got[1]["n_lines_dropped"] == 40_000
    assert got[2]["text"] == "mine"


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark):
    rows = [(k, f"{'insult' if k % 2 else 'pleasant'} other words here {k}") for k in range(60)] + [(1, f"insult again {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, labels, toxicity.ToxicParams(sample=60))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, machine).collect()}
    assert got == {k: k % 2 for k in range(60)}


def test_vectors_of_several_lengths_link_with_their_own(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=(2, 3, 5)[k % 3])).tolist()) for k in range(300)] + [(300, [1.0, 0.0, 1e-9]), (301, [1.0, 0.0, 0.0]), (302, [0.0, 0.0]), (303, []), (304, None), (305, [1.0, float("nan")]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    root = components(range(306), linked)
    n = {i: sum(i in p for p in linked) for i in range(306)}
    for cell, block in ((4096, 4096), (10, 7)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(df, 0.9, cell=cell, block=block).collect()}
        assert got.pop(None) == (0, None)
        assert got == {i: (n[i], root[i]) for i in range(306)}


def test_needless_rules_go_and_lifted_ones_stay(spark):
    rules = spark.createDataFrame([(["a"], 0.9, 0.1), (["a", "b"], 0.9, 0.1), (["a", "b", "c"], 0.95, 0.1), (["b", "c"], 0.6, 0.1), (["d"], 0.8, 0.1)], "antecedent array<string>, confidence double, support double")
    assert sorted(r[0] for r in urlrules._needless(rules, 10).collect()) == [["a", "b"]]
    rows = [(f"http://x/common/w{k % 2}/{k}", k % 10 > 2) for k in range(200)]  # 70 of 100 are bad, whatever the token
    assert urlrules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


def test_conversations_are_packed_whole_under_three_limits(spark):
    """Every answer lies in its prompt's sequence, after it, unless its conversation is over a limit; then its exchange stays together."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    word = lambda n: " ".join(["word"] * n)
    rows = [(k // 4, k % 4, "assistant" if k % 2 else "user", word(1 + 37 * k % 90)) for k in range(400)]
    rows += [(500, t, "assistant" if t % 2 else "user", word(60 + t % 7)) for t in range(300)]  # over all limits, exchange by exchange
    rows += [(501, 0, "user", word(30)), (501, 1, "assistant", word(3000)), (502, 0, "user", word(5000)), (502, 1, "assistant", word(20))]
    rows += [(503, 2, None, None), (503, 3, "user", " "), (None, 0, "user", "word"), (None, 1, "assistant", "word word"), (504, None, "assistant", "word"), (505, 0, "user", word(5)), (505, 0, "user", word(5))]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, tie int, n int").repartition(5)
    limits = packing.Limits(segments=24, loss=1024)
    got = packing.pack_conversations(turns, queries.tokenizer_path(), limits).collect()
    by, used = {}, {}
    for r in got:
        by.setdefault((r["conv_id"], r["turn"]), []).append((r["start"], r["length"], r["sequence_id"], r["offset"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["loss"], r["conv_id"]))
    count = lambda text: len(tok.encode(text or "", add_special_tokens=False).ids)
    for conv, turn, role, text in rows[:-2]:
        at = 0
        for start, length, *_ in sorted(by.get((conv, turn), [])):
            assert start == at
            at += length
        assert at == count(text)
    assert len(by[505, 0]) == 2
    for parts in used.values():
        parts.sort()
        assert sum(p[1] for p in parts) <= 2048 and len({p[3] for p in parts}) <= 24 and sum(p[2] for p in parts) <= 1024
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    for conv in range(100):
        placed = [by[conv, t][0] for t in range(4) if (conv, t) in by]
        assert len({p[2] for p in placed}) == 1 and all(a[3] + a[1] == b[3] for a, b in zip(placed, placed[1:]))
    together = sum(by[500, t][0][2] == by[500, t + 1][0][2] for t in range(0, 300, 2))
    assert together >= 150 - 4  # ranges of turns may cut where tasks meet
    full = sum(sum(p[1] for p in parts) > 1800 or sum(p[2] for p in parts) > 900 for parts in used.values())
    assert full >= len(used) * 0.5
    none = packing.pack_conversations(turns.limit(0), queries.tokenizer_path(), limits)
    assert none.count() == 0


def test_packed_query_keeps_conversations_together(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["packed_turns"](spark, sf).collect()
    total, where = {}, {}
    for r in rows:
        n, loss = total.get(r["conv_id"], (0, 0))
        total[r["conv_id"]] = n + r["length"], loss + r["loss"]
        where.setdefault(r["conv_id"], set()).add(r["sequence_id"])
    assert all(len(where[c]) == 1 for c, (n, loss) in total.items() if n <= 2048 and loss <= 1536) and len(where) > 10


def test_id_filters_pass_their_ids_and_joins_are_exact(spark, monkeypatch):
    gone = spark.range(0, 5000, 7).withColumnRenamed("id", "doc_id")
    docs = spark.range(-50, 3000).selectExpr("id AS doc_id", "'x' AS _gone").union(spark.sql("SELECT CAST(NULL AS long), 'null'")).union(spark.sql("SELECT 3L, 'again'"))
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(membership, "BITS", bits)
        found = membership.IdFilter.of(gone)
        places = np.array([r[0] for r in gone.select(membership.place(F.col("doc_id"))).collect()])
        assert found.holds(places).all() and found.holds(np.arange(bits)).sum() <= 715
        left = membership.without_ids(docs, gone)
        assert left.columns == docs.columns
        want = [(k, "x") for k in range(-50, 3000) if k < 0 or k % 7] + [(None, "null"), (3, "again")]
        assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, want))
    assert membership.without_ids(docs, gone.limit(0)).count() == docs.count()


def test_html_output_is_bounded_by_the_page():
    """Rows whose spans pile up, wide spans beside wide cells, and deep tables: none makes more than some times its own length."""
    spanned = "<table>" + "<tr><td rowspan=65534>a<td>b" * 4000 + "</table>"
    wide = "<table><tr>" + ("<td>" + "x" * 60) * 100 + "<tr><td colspan=100><td>y" * 4000 + "</table>"
    deep = "<table><tr><td>k<td>" * 3000 + "end"
    for page in (spanned, wide, deep):
        text = htmltext.render(page)
        assert len(text) <= 10 * len(page) + 5000
    assert htmltext.render(spanned).count("a") == 4000 and htmltext.render(deep).count("k") == 3000 and "end" in htmltext.render(deep)


def test_html_visibility_is_inherited_and_undone():
    page = '<div style="visibility:hidden">no<p style="visibility: visible">yes</p><table><tr><td>a<td style="visibility:visible">b</table></div><p>after'
    assert htmltext.render(page).split() == ["yes", "b", "after"]
    sheet = """<style>/* .shown{display:none} */ .gone, #x > b, p.odd { color:red; display : none } @media print { .printed{display:none} } @import 'a'; #it{visibility:hidden} span{display:none} span.kept{display:inline}</style>
    <div class="a gone">no</div><p class=odd>no</p><b class=odd>yes</b><div class=shown>one</div><div class=printed>two</div><div id=it>no<i style="visibility:visible">three</i></div><span>no</span><span class=kept>four</span> <span style="display:inline">five</span>"""
    assert htmltext.render(sheet).split() == ["yes", "one", "two", "three", "four", "five"]


def test_html_tables_within_cells_keep_their_columns():
    page = "<table><tr><td>k<td><table><tr><td>1<td>2222<tr><td>33<td>4</table><td>z<tr><td>long<td>x<td>y</table>"
    assert htmltext.render(page).split("\n") == ["k     1   2222  z", "      33  4", "long  x         y"]


def test_constant_paths_do_not_double_the_rules(spark):
    """Thirty tokens that half or all of the URLs share are one to the miner."""
    path = "/".join(f"part{k}" for k in range(30))
    rows = [(f"https://x.org/{path}/p{k}" if k % 2 else f"https://y.org/q{k}", k % 2 == 1 and k % 10 != 1) for k in range(300)]
    mined = urlrules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert [(r["antecedent"], r["confidence"]) for r in mined] == [(["org", "part0"], 0.8)] or all("part0" in r["antecedent"] or "x" in r["antecedent"] for r in mined) and len(mined) <= 3
    every = [(f"https://x.org/{path}/w{k % 3}/{k}", k % 3 == 0) for k in range(300)]
    lifted = urlrules.mine_rules(spark.createDataFrame(every, "url string, bad boolean"), urlrules.UrlParams(min_lift=1.0, min_confidence=0.3)).collect()
    assert len(lifted) <= 4 and ["w0"] in [r["antecedent"] for r in lifted]
    judged = urlrules.judge_urls(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(every)], "page_id long, url string"), [], spark.createDataFrame([r for r in lifted if r["confidence"] == 1], "antecedent array<string>, confidence double, support double"))
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {k: "block" if k % 3 == 0 else "allow" for k in range(300)}


def test_earlier_versions_stay_readable(spark, tmp_path):
    """Each arrival's version holds what came until then; the merge of four loses and repeats nothing."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    store = compaction.compact_arrivals(docs, f"file://{tmp_path}/t", keep=10)
    versions = store.versions()
    assert versions == list(range(1, len(versions) + 1)) and len(versions) >= 5
    rows = [sorted(r["doc_id"] for r in store.read(v).collect()) for v in versions]
    assert 0 < len(rows[0]) < 400 and rows[3] == rows[-1] == list(range(400))
    assert all(set(a) <= set(b) and len(a) == len(set(a)) for a, b in zip(rows, rows[1:]))
    found = queries.QUERIES["shard_versions"](spark, "/root/testdata/sf0.001").groupBy("version").count().orderBy("version").collect()
    assert [r["version"] for r in found] == versions and found[-1]["count"] == queries.table(spark, "/root/testdata/sf0.001", "documents").count()


def family(n, slots=30, seed=0):
    """Texts of one template whose slots hold one of two words: most pairs are just below the threshold, some are above."""
    rng = np.random.default_rng(seed)
    return [" ".join(f"fix{s} word{s} {'left' if rng.random() < 0.5 else 'right'}{s} mid{s} end{s} tail{s} more{s}" for s in range(slots)) for _ in range(n)]


@pytest.mark.parametrize(("limit", "rare"), [(64, 64), (5, 8)])
def test_families_are_compared_without_pairs(spark, monkeypatch, limit, rare):
    """Of a family's n(n-1)/2 pairs none but links become rows, and no link is lost."""
    texts = family(150) + [t + " extra" for t in family(20)] + family(60, 8, 1) + [f"lone text number {k}" for k in range(20)]
    asked = []
    confirmed = minmax._confirmed
    monkeypatch.setattr(minmax, "_confirmed", lambda pairs, sets, percent: asked.append(pairs.count()) or confirmed(pairs, sets, percent))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(docs, minmax.MinMaxParams(family=limit, rare=rare)).collect()}
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == components(range(len(texts)), links) and links
    assert sum(asked[:2]) < 24 * len(texts) and (limit > 5 or asked[2] < 5 * len(texts))  # below the limits pairs are rows, so many a text at most


def test_links_in_blocks_join_components_only(spark):
    texts = family(90, 12, 3)
    sets = [shingles(t) for t in texts]
    names = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    held = spark.createDataFrame([(k, sorted(names[x] for x in s)) for k, s in enumerate(sets)], "doc_id long, shingles array<long>")
    members = spark.createDataFrame([(7, k, k, len(s)) for k, s in enumerate(sets)] + [(8, k, 0, len(sets[k])) for k in range(20)], "bucket long, node long, component long, n long")
    want = components(range(90), [(a, b) for a in range(90) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    for most in (1024, 16):
        found = [tuple(r) for r in minmax.links_in_blocks(members, held, 85, most).collect()]
        assert components(range(90), found) == want and (most < 90 or len(found) == 90 - len(set(want.values())))
        assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in found)


def test_encoder_learns_stems_once():
    from tokenizers import Tokenizer

    from fluxmill.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    encode = packing.Encoder(tok)
    texts = ["Seldwyla seldwyla, SELDWYLA.", "It's 3.5, A'LL. don't. ..., É. É, x\x0by.\x0cz \x02 b\x02c. " + "Z" * 90 + ".", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert {b"seldwyla", b"seldwyla,", b"seldwyla."} <= set(encode.known) and b"Seldwyla" not in encode.known
    asked = []
    encode._encoded = lambda words: asked.extend(words) or iter(())
    encode(["Seldwyla. SELDWYLA, y, z."])
    assert not {b"y,", b"z.", b"seldwyla"} & set(asked)
