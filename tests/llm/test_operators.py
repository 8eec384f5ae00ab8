"""Small and hostile inputs against brute force."""

import itertools
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowmend.llm import binary, html, jaccard, langid, neardup, packing, pieces, quality, tokens, topk, toxicity
from rowmend.llm.common import components, crc_ids
from rowmend.llm.queries import tokenizer_file

WORDS = "word_bpe_49k.json"
TEXTS = ["one two three four five six seven eight nine ten", None, "", "  \t\n", "one", "one two", "Été à la plage, it's fine!", "x" * 3000, "漢字 and ▁ marks \U0001f600", "one two three four five six seven eight nine ten"]


def docs(spark, texts=TEXTS, extra=""):
    rows = [(i, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def long_text(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeéz"), 5)) for _ in range(n))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 502), (900, 900)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def brute_components(rows, linked):
    up = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(up[a], up[b])
            if up[a] != m or up[b] != m:
                up[a] = up[b] = m
                changed = True
    return up


def test_jaccard(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 500, n)] for n in (8, 30, 60, 120, 400)]
    texts = list(TEXTS)
    for words in base:
        for edits in (0, 0, 1, 1, 2, 3, 5):
            w = list(words)
            for k in rng.integers(0, len(w), edits):
                w[k] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(w).upper() if edits == 1 else " ".join(w))
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df.repartition(5)).collect()}

    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(range(len(texts)), links)
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert jaccard.jaccard_components(df.limit(0)).isEmpty()


def test_jaccard_comes_back_for_pairs_cut_off(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, texts = [f"w{x}" for x in rng.integers(0, 10**6, 3000)], []
    for _ in range(8):
        group = list(base)
        for k in rng.integers(0, 3000, 60):
            group[k] = f"g{rng.integers(0, 10**9)}"
        for _ in range(5):
            w = list(group)
            for k in rng.integers(0, 3000, 12):
                w[k] = f"v{rng.integers(0, 10**9)}"
            texts.append(" ".join(w))
    order = rng.permutation(len(texts)).tolist()
    texts = [texts[k] for k in order]
    monkeypatch.setattr(jaccard, "CUT", 1e-3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(4)))) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85]
    assert got == brute_components(list(range(len(texts))), links) and len(set(got.values())) == 8


def test_cell_goes_on_after_a_passed_cut():
    ids, group = np.arange(60), np.repeat([0, 1, 2], [1, 19, 40])
    points, ends = np.full((60, jaccard.GROUPS), 2), {i: i for i in range(60)}
    known, passed = [], []
    for turn in range(20):
        component = np.array([ends[i] for i in range(60)])
        failed = np.array([(a, b) for a, b, ok in known if not ok], np.int64).reshape(-1, 2).T
        a, b, more = jaccard.cell_pairs(ids, points, points.sum(1), component, failed, turn, 85, 100, None, 0.001)
        fresh = [(i, j, bool(group[i] == group[j])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        known += fresh
        ends = brute_components(range(60), [(a, b) for a, b, ok in known if ok])
        passed += [len(set(ends.values()))] if turn and more and all(ok for *_, ok in fresh) else []
        if not more and all(ok for *_, ok in fresh):
            break
    assert len(set(ends.values())) == 3 and passed[0] > 3  # a cut list passed entirely while links were left


def test_jaccard_short_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    rng = np.random.default_rng(21)
    whole = "w525230 w911474 w360039 w756135 w919351 w345362 w789207 w436315 w818764"
    texts = [whole, whole.split(" ", 1)[1]]  # four of five shingles
    for n in rng.integers(5, 13, 150).tolist():
        words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        texts += [" ".join(words), " ".join(words[1:]), " ".join(words[:-1]), " ".join([*words, "more"])]
    for words, num in ((4, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(spark, texts), words, num, 100).collect()}
        sets = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)} for w in (t.split() for t in texts)]
        links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
        assert got == brute_components(range(len(texts)), links)
        assert num == 85 or got[1] == 0


def test_first_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    ranks = rng.permutation(1 << jaccard.BUCKETS).astype(np.uint32)
    for n in range(1, 200):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        left = rng.permutation(s)[: -(-85 * n // 100)]
        other = np.unique(np.concatenate([left, rng.integers(0, 1 << 63, max(0, (100 * len(left) - 85 * n) // 85)).astype(np.uint64)]))
        both = len(np.intersect1d(s, other))
        if 100 * both >= 85 * (len(s) + len(other) - both):
            assert set(jaccard.first_shingles(s, ranks, 85, 100)) & set(jaccard.first_shingles(other, ranks, 85, 100))


def test_rtree_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 3, (300, jaccard.GROUPS))
    points[150:] = points[:150]
    points[150:, :3] += 1
    sizes = points.sum(1)
    tree = jaccard.Tree(points, sizes)
    blocks = {tuple(b) for b in tree.blocks(85, 100).tolist()}
    where = np.argsort(tree.order) // jaccard.LEAF
    for i, j in itertools.combinations(range(300), 2):
        if jaccard.may_link(points[i], points[j], sizes[i], sizes[j], 85, 100):
            assert tuple(sorted((where[i], where[j]))) in blocks


def test_packing(spark):
    path = tokenizer_file(WORDS)
    df = docs(spark, TEXTS + [long_text(3000, i) for i in range(6)])
    got = packing.pack(df.repartition(3), path).collect()
    lib = tokens.tokenizer(path).library
    whole = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in df.collect()}
    back, seqs = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        back.setdefault(r.doc_id, []).append((r.start, ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, len(ids)))
        assert r.doc_tokens == len(whole[r.doc_id])
    assert {k: sum((i for _, i in sorted(v)), []) for k, v in back.items()} == whole
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(df.limit(0), path).isEmpty()


def test_binary_round_trip(spark, tmp_path):
    path = tokenizer_file(WORDS)
    df = docs(spark, TEXTS + [long_text(3000, i) for i in range(4)])
    lib = tokens.tokenizer(path).library
    binary.write_tokens(df.repartition(3), str(tmp_path / "a"), path)
    start = 0
    for r in binary.read_tokens(spark, str(tmp_path / "a")).orderBy("doc_id").collect():
        want = [*lib.encode(df.where(F.col("doc_id") == r.doc_id).first().text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.start == start
        start += len(want)
    binary.write_tokens(df.limit(0), str(tmp_path / "b"), path)
    assert binary.read_tokens(spark, str(tmp_path / "b")).isEmpty()


def test_huffman_lengths():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 5), (2, 5), (7, 3), (40, 6), (300, 9), (300, 18)):
        counts = (rng.pareto(0.4, n) * 10).astype(np.int64) + 1
        lengths = binary.code_lengths(counts, limit)
        assert lengths.max() <= limit
        assert n == 1 or sum(2.0**-x for x in lengths.tolist()) == 1.0
        if limit == 18 and n > 1:  # as short as without a limit
            import heapq

            heap, cost = counts.tolist(), 0
            heapq.heapify(heap)
            while len(heap) > 1:
                x = heapq.heappop(heap) + heapq.heappop(heap)
                cost += x
                heapq.heappush(heap, x)
            assert cost <= int((lengths * counts).sum()) <= cost * 1.01 + 1
        ids = rng.choice(n, 5000, p=counts / counts.sum()).astype(np.uint32)
        book = binary.Codebook(np.arange(n), lengths)
        bits, marks = book.encode(ids)
        assert (binary.decode(bits, marks, len(ids), book.table(), book.longest) == ids).all()


def test_tokenizer_matches_library():
    t = tokens.WordTokenizer(tokenizer_file(WORDS), keep=3)
    odd = [*TEXTS, "it's 'sword don't", "a<|endoftext|>b", "x\x1cy\x85z\xa0w", "ΑΣ ΟΔΟΣ.", "µªº ÀÉ ß÷×", "a1b2c3!!d", "İI\u0307, H\u0331.É. é. A;漢. <|ENDOFTEXT|>"]
    for got, text in zip(t.encode(pa.array(odd), 7), odd, strict=True):
        assert got.tolist() == [*t.library.encode(text or "", add_special_tokens=False).ids, 7]


def test_pieces(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    v = pieces.vocabulary(path)

    def brute(marked):
        best = [(0.0, None)]
        for e in range(1, len(marked) + 1):
            options = []
            for s in range(max(0, e - v.longest), e):
                p = marked[s:e]
                if p in v.scores:
                    options.append(best[s][0] + v.scores[p])
                elif s == e - 1:
                    options.append(best[s][0] + v.byte_cost * len(p.encode()))
            best.append((max(options), None))
        return best[-1][0]

    texts = ["hello world  foo", long_text(40), "ab" * 100, "a\nb", "漢字 \U0001f600", "x" * 200, "▁ a▁b", "  ", None, ""]
    for text, ids in zip(texts, v.encode(pa.array(texts)), strict=True):
        total = sum(v.byte_cost if i in v.bytes.values() else v.scores[v.pieces[i]] for i in ids.tolist())
        marked = "▁" + text.replace("▁", pieces.LITERAL).replace(" ", "▁") if text else ""
        assert math.isclose(total, brute(marked.replace(pieces.LITERAL, "\ua9c1")), rel_tol=1e-12)  # another character of three bytes
        assert v.decode([ids]) == [text or ""]
    out = pieces.decode(pieces.encode(docs(spark), path), path).collect()
    assert {r.doc_id: r.text for r in out} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert pieces.decode(pieces.encode(docs(spark, ["a b", "a b"]).limit(0), path), path).isEmpty()


def test_pieces_commit_inside_a_long_word():
    v = pieces.Vocabulary(tokenizer_file("piece_bpe_32k.model"))
    word = "".join(np.random.default_rng(3).choice(list("abcde"), 5000))
    shapes, edges = [], v._edges
    v._edges = lambda *a: (shapes.append(int((a[2] - a[1]).max())), edges(*a))[1]
    ids, sizes = v.viterbi(["▁" + word])
    assert v.windows > 5000 / (4 * v.longest) and max(shapes) <= 8 * v.longest  # bounded windows, committed one by one
    assert sizes.tolist() == [len(ids)] and v.decode([ids]) == [word]
    best = [0.0]
    for e in range(1, len(word) + 2):
        best.append(max(best[s] + (v.scores[p] if (p := ("▁" + word)[s:e]) in v.scores else v.byte_cost if s == e - 1 else -math.inf) for s in range(max(0, e - v.longest), e)))
    assert math.isclose(sum(v.scores[v.pieces[i]] for i in ids.tolist()), best[-1])


def test_langid(spark):
    rows = [(i, " ".join(["the cat and the dog"] * 9), "en") for i in range(20)] + [(100 + i, " ".join(["der hund und die katze"] * 9), "de") for i in range(9)] + [(200, None, "en"), (201, "", None), (202, "1234 !!", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert list(model) == ["en", "de"]
    out = {r.doc_id: r for r in langid.identify(df.withColumn("score", F.lit("x")), model).collect()}
    assert out[0].lang_pred == "en" and out[100].lang_pred == "de" and not out[0].rejected
    assert all(out[i].lang_pred == "und" and out[i].rejected and out[i].score == 0 for i in (200, 201, 202))
    assert langid.identify(df, langid.fit(df.limit(0))).where("lang_pred <> 'und'").isEmpty()


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows = []
    for i in range(400):
        words = list(rng.choice(vocabulary, 30))
        if i % 5 == 0:
            words[int(rng.integers(0, 30))] = "zorkish"
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any(" zorkish ".startswith(t) for t in lexicon.weights)
    tests = [(1, "you Z0RK1SH thing here"), (2, "a clean text here"), (3, None), (4, ""), (5, "zоrkish with a look-alike")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), lexicon).collect()}
    assert got[1] > 0.7 and got[5] > 0.7 and max(got[2], got[3], got[4]) < 0.5
    lexicon.exceptions.append(" zorkish thing ")
    m = toxicity.Matcher(lexicon)
    assert m.features("a zorkish thing")[0] == 0 and m.features("a zorkish man")[0] > 0
    # Against a plain scan for each pattern.
    lexicon = toxicity.Lexicon({" zork": 2.0, " bad ": 1.0, "aabb": 0.5}, [" zorkish thing ", " not bad "], -1.0, (1.0, 0.1))
    m, words = toxicity.Matcher(lexicon), ["zork", "zorkish", "thing", "bad", "not", "aabb", "xaabbaabb", "B4D", "ok"]
    for _ in range(300):
        text = toxicity.folded(" ".join(rng.choice(words, int(rng.integers(1, 9)))))
        spans = {t: [(i, i + len(t)) for i in range(len(text)) if text.startswith(t, i)] for t in [*lexicon.weights, *lexicon.exceptions]}
        barred = [x for t in lexicon.exceptions for x in spans[t]]
        total = sum(w for t, w in lexicon.weights.items() for a, b in spans[t] if not any(c <= a and b <= d for c, d in barred))
        assert math.isclose(m.features(text)[0], math.log1p(total))
    empty = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert toxicity.score(df, empty).where("score > 0.5").isEmpty()


PAGE = '<html><head><title>x</title><script>if (a<b) {"</p>"}</script></head><body><nav class="top-1"><a href="/">Home</a></nav><div class="ad">Buy</div><article id="a"><h1>A &amp; B</h1><p><b>One   two.<br><p>Three\n four &eacute;.</p><aside>side</aside><ul><li>item</ul><div class="comments"><p>first!</p></div></article><form><p>mail</p></form><footer>&copy; me</footer></body></html>'


def test_html(spark):
    rows = [(i, f"http://h.example/{i}", PAGE) for i in range(5)] + [(10, None, None), (11, "http://h.example/x", ""), (12, "odd url", "plain text"), (13, "http://h.example/y", "<p>cut <b off")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "A & B\nOne two.\nThree four é.\nitem"
    assert got[10] == got[11] == "" and got[12] == "plain text" and got[13].startswith("cut")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_html_whole_article(spark):
    body = "<p>" + "Long body text. " * 60 + "</p>"
    lead = "<html><body><div class='links'><a href='/'>Other pages of the site</a></div><article><h1>Title</h1><div class='lead'><p>Lead.</p></div><div class='body'>" + body + "</div></article></body></html>"
    plain = "<html><body><div class='wrap'><div class='top'><h1>Title</h1></div><div><div class='lead'><p>Lead.</p></div><div class='body'>" + body + "</div></div></div></body></html>"
    rare = "<html><body><div class='post'><p>Teaser.</p></div><table><tr><td class='story'><p>" + "Whole story. " * 30 + "</p></td></tr></table></body></html>"
    usual = "<html><body><div class='post'>" + body * 3 + "</div></body></html>"
    rows = [(0, "http://a.example/0", lead), (1, "http://b.example/1", plain), (2, "http://c.example/2", rare)] + [(3 + i, f"http://c.example/{i}x", usual) for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    long = ("Long body text. " * 60).strip()
    assert got[0] == f"Title\nLead.\n{long}" and got[1] == f"Title\nLead.\n{long}"
    assert got[2] == "Teaser.\n" + ("Whole story. " * 30).strip() and got[3] == "\n".join([long] * 3)


def test_html_words_bar_no_article():
    def read(body):
        return [b[2] for b in html.blocks(f"<html><body>{body}</body></html>")]

    story, menu = "<p>Story.</p><p>More of the story.</p>", "<div class='sidebar'><p>Side.</p></div>"
    for name in ("class='content with-sidebar'", "class='layout no-sidebar'", "id='search-results'", "class='legal'"):
        assert read(f"<div {name}>{story}</div>{menu}") == ["Story.", "More of the story."], name
    assert read(f"<div class='widget'><article>{story}</article></div>{menu}") == ["Story.", "More of the story."]
    assert read(f"<article><div class='entry-header'><h1>Title</h1></div>{story}</article>{menu}") == ["Title", "Story.", "More of the story."]
    assert read("<div class='notice'>Only words.</div>") == ["Only words."]
    comments = "<div class='comments'><article class='comment'><p>" + "A long comment. " * 20 + "</p></article></div>"
    assert read(f"<article>{story}</article>{comments}") == ["Story.", "More of the story."]


def test_html_deep_nesting_is_linear():
    def took(n):
        page = "<div class='widget'>x" * n + "<p>Story.</p>"
        start = time.process_time()
        found = html.blocks(page)
        assert found and html.text_under(found, {html.best_path(found)[0].hash})
        return time.process_time() - start

    took(100)
    assert took(20_000) < 25 * took(2_000) + 0.5


def test_html_paths_stay_with_their_page(spark, monkeypatch):
    rows = [(i, "http://h.example/", f"<body><div class='post tag-{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8]}'><p>Text {i}.</p></div></body>") for i in range(64)]
    seen = spark.sparkContext.accumulator(0)

    def text_under(found, paths, inner=html.text_under):
        seen.add(len(paths))
        return inner(found, paths)

    monkeypatch.setattr(html, "text_under", text_under)
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i}." for i in range(64)} and 64 <= seen.value <= 2 * 64


def vectors(spark, n=300, width=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[100:140] = x[0] + rng.normal(size=(40, width)) * 0.03
    x[140:150] = x[1]
    rows = [(i, [float(v) for v in np.float32(r)], int(i % 3) if i >= 150 else 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * width, 0), (1003, [float("nan")] * width, 0), (1004, [None] * width, 0), (1005, rows[1][1], None), (1006, [1.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_topk(spark):
    rows, df = vectors(spark)
    points = topk.quantised(df)
    got = {}
    for r in topk.top_k(points, points.where("vec_id % 20 = 0"), 7, 64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    sound = {i: [math.floor(64 * v) for v in e] for i, e, _ in rows if e and all(v is not None and math.isfinite(v) for v in e)}
    for q in (i for i in sound if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:7])]
    assert topk.top_k(points.limit(0), points.limit(0)).isEmpty()


def test_topk_ties_copies_and_levels(spark):
    rng = np.random.default_rng(8)
    centres = rng.integers(-60, 60, (12, 6))
    rows = [(i, (centres[i % 12] + rng.integers(-2, 3, 6)).tolist()) for i in range(900)]
    rows += [(1000 + i, [9, 9, 9, 9, 9, 9]) for i in range(300)]  # a group of copies that no centre parts
    rows += [(40, [1, 2, 3, 4, 5, 6]), (1000, [9, 9, 9, 9, 9, 9])]  # repeated ids
    points = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(points, points.where("vec_id % 20 = 0"), 5, 16).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in {i for i in ids.tolist() if i % 20 == 0}:
        mine = sorted(g[1:] for g in got if g[0] == q)
        asked = np.flatnonzero(ids == q)
        want = sorted({(-int(x[a] @ x[b]), int(ids[b]), int(a) if len(asked) == 1 else 0, int(b)) for a in asked for b in range(len(ids)) if ids[b] != q})[: 5 * len(asked)]
        assert [m[1:] for m in mine] == [(w[1], -w[0]) for w in want][:5] or len(asked) > 1
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]


def test_cover_trees_prune():
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, (40, 16))
    near = centres[rng.integers(0, 40, 4000)] + rng.integers(-4, 5, (4000, 16))
    for x, most in ((near, 0.25), (rng.integers(-64, 64, (4000, 16)), 1.0)):
        data, queries = topk.CoverTree(np.arange(4000), x).prepare(), topk.CoverTree(np.arange(0, 4000, 20), x[::20], topk.Q_LEAF).prepare()
        for t in (data, queries):
            assert len(t.kids) > 10 and sorted(t.ids.tolist()) == list(range(0, 4000, 1 if t is data else 20))
            for a in range(len(t.lo)):
                assert np.linalg.norm(t.exact[t.lo[a] : t.hi[a]] - t.exact[t.lo[a]], axis=1).max() <= t.radius[a] + 1e-9
        search = topk.Search(queries, 10)
        search.run(data)
        share = search.scored / (200 * 4000)
        assert share <= most, share
        who, ids, score = search.found()
        for q in range(0, 4000, 400):
            want = sorted((-int(s), i) for i, s in enumerate((x @ x[q]).tolist()) if i != q)[:10]
            assert [(-s, i) for s, i in zip(score[who == q].tolist(), ids[who == q].tolist(), strict=True)] == want


def test_near_duplicates(spark):
    rows, df = vectors(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df.repartition(4)).collect()}
    ok = {i: (np.array(e, float), y) for i, e, y in rows if e and y is not None and all(v is not None and math.isfinite(v) for v in e) and any(e)}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.93]
    want = brute_components([r[0] for r in rows], links)
    for i, _, _ in rows:
        assert got[i] == (sum(i in p for p in links), want[i], want[i] == i), i
    assert neardup.near_duplicates(df.limit(0)).isEmpty()


def brute_near_duplicates(rows, threshold=0.93):
    """{id: (n_links, component_id, kept)} of (id, vector, label)."""
    unit = {i: np.array(e, float) / np.linalg.norm(e) for i, e, _ in rows}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if label[a] == label[b] and unit[a] @ unit[b] >= threshold]
    want = brute_components(list(unit), links)
    return {i: (sum(i in p for p in links), want[i], want[i] == i) for i in unit}


def near_groups(seed=3, width=24, size=14, groups=6):
    """Tight groups of different near-copies around centres, each pair of groups next to one another joined by weaker links only."""
    rng = np.random.default_rng(seed)
    rows, basis = [], np.linalg.qr(rng.normal(size=(width, width)))[0]
    for g in range(groups):
        angle = 0.36 * (g % 2)
        centre = math.cos(angle) * basis[g - g % 2] + math.sin(angle) * basis[g - g % 2 + 1]
        for _ in range(size):
            rows.append((len(rows), [float(v) for v in centre + rng.normal(size=width) * 0.006], 0))
    return rows


def test_near_duplicates_saturated_lists(spark):
    rows = near_groups()
    want = brute_near_duplicates(rows)
    assert len({c for _, c, _ in want.values()}) == 3
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def audited(spark, x, joined):
    points = spark.createDataFrame([(0, x.shape[1], i, 1, [float(v) for v in r]) for i, r in enumerate(x)], "label long, width int, id long, copies long, x array<double>")
    return neardup.audit(points.repartition(3), spark.createDataFrame(joined, "id long, component_id long"), 0.93)[0]


def test_audit_sees_small_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))
    x[:400] = x[0] + rng.normal(size=(400, 24)) * 0.01
    x[500:] = x[400:500] + 1e-3
    assert 0.5 < audited(spark, x, [(i, 0) for i in range(400)]) < 0.8  # the pairs 400 to 599 were missed
    few = rng.normal(size=(1500, 24))
    few[1499] = few[0] + 1e-3
    assert audited(spark, few, [(5, 5)]) == 0.0


def test_near_duplicates_exact_where_turns_run_out(spark, monkeypatch):
    rows = near_groups()
    none = spark.createDataFrame([], "u long, v long, cos double")
    monkeypatch.setattr(neardup, "_first_lists", lambda *a: none)
    monkeypatch.setattr(neardup, "_refined", lambda *a: none)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), turns=1, most=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_near_duplicates(rows)


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40)) for _ in range(200)]
    junk = ["%%% ### $$$ " * 20 for _ in range(50)]
    df = docs(spark, good + junk + [None, "", "ab"])
    out = quality.resample(df.withColumn("key", F.lit(1)), spark.createDataFrame([(t,) for t in good[:50]], "text string")).collect()
    chosen = {r.doc_id: r.selected for r in out}
    assert all(chosen[i] for i in range(200)) and not any(chosen[i] for i in range(200, 250)) and all(chosen[i] for i in (250, 251, 252))
    keys = spark.createDataFrame([(float(x),) for x in [*range(100), 50, 50, -3.5]], "key double")
    for k in (1, 7, 50, 103):
        assert quality.kth_largest(keys, "key", k) == sorted([*map(float, range(100)), 50, 50, -3.5], reverse=True)[k - 1]


@pytest.mark.parametrize("data", [b"\x01\x00\x00\x00"])
def test_crc(data):
    import zlib

    assert crc_ids(np.array([1])) == zlib.crc32(data)
