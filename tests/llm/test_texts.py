"""Operators on single documents, against plain versions of themselves."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest

from symdex.llm import chat_format, decontaminate, html_text, language_id, quality_crf, quality_rules, secret_scan, token_codec, token_lengths
from symdex.llm.wordhash import BY_SIGN, BY_SPACE, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_word_hashes_name_words():
    docs = ["Aa b\tc", "", "aA B  c\n", "é É x", "\x0bend"]
    h, first, starts, ends, data = BY_SPACE.hashes([d.encode() for d in docs])
    words = [data[a:b].decode() for a, b in zip(starts, ends)]
    assert words == [w for d in docs for w in WORD.findall(d)]
    same = {}
    for w, x in zip(words, h.tolist()):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
        assert same.setdefault(low, x) == x
    assert len(set(same.values())) == len(same)
    assert np.diff(first).tolist() == [len(WORD.findall(d)) for d in docs]
    _, first, _, _, _ = BY_SIGN.hashes([b"A-b_c 9Z", "né!".encode()])
    assert np.diff(first).tolist() == [4, 1]
    assert len(runs(h, 99)) == 0
    # words of one length made of two letters so regularly that sums of powers of an even modulus can't tell them apart
    for rounds in range(3, 15):
        word = "a"
        for _ in range(rounds):
            word += word.translate(str.maketrans("ab", "ba"))
        h = BY_SPACE.hashes([f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word.upper()}".encode()])[0]
        assert h[0] != h[1] and h[0] == h[2]


def test_op1_features_and_cascade(odd_docs, no_docs):
    def plain(t):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    extra = odd_docs.sparkSession.createDataFrame([(20, "a b c x a b c a b c", "en"), (21, "x\nx\n\n\nx y\nx y #", "en"), (22, "a a a a a a", "en")], "doc_id bigint, text string, lang string")
    for df in (odd_docs, extra):
        got = quality_rules.verdicts(df).collect()
        want = sorted((i or -1, *plain(t)) for i, t in texts(df))
        assert sorted((r["doc_id"] or -1, *[r[c] for c in quality_rules.RETURNED]) for r in got) == want
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert by_id(quality_rules.verdicts(odd_docs))[1]["kept"]
    assert quality_rules.verdicts(no_docs).collect() == []


def test_op1_order_of_the_cascade(spark, odd_docs, no_docs, prose, tmp_path):
    order = quality_rules.estimate(odd_docs.select("text"))
    assert {r for r, _, _ in order} == set(quality_rules.RULES) and all(w > 0 and 0 <= share <= 1 for _, w, share in order)
    assert order == quality_rules.estimate(odd_docs.select("text")) and len(quality_rules.estimate(no_docs.select("text"))) == len(order)
    dear = ("shouting", "few_letters", "repeated_lines")  # their features are not returned anyway
    rows = [(i, prose(60, i).upper() if i % 2 else "few words", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names = [r.name for r, _, _ in quality_rules.estimate(df.select("text"))]
    assert names[0] == "few_words" and names.index("shouting") < names.index("few_letters") and set(names[:4]).isdisjoint({"repeated_lines", "few_letters"})
    assert all(w > 1 for r, w, _ in order if r.name in dear) and all(w == 1 for r, w, _ in order if r.name not in dear)
    df.repartition(7).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    assert quality_rules.spread_sample(stored, rows=20, files=4).count() == 20 and quality_rules.spread_sample(stored, rows=4000).count() == 40
    assert {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(stored).collect()} == dict.fromkeys(range(40), False)
    rule = quality_rules.Rule("letters", "{n_letters} < 5")
    assert by_id(quality_rules.verdicts(df, rules=(rule,), sample=df.limit(0)))[0]["kept"]


def test_op2_field_marginals_and_held_out(spark, odd_docs, no_docs, prose):
    rng = np.random.default_rng(1)
    good, stay, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    p, z, pairs = quality_crf.forward_backward(good, first, stay)
    total = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        states = [[int(c) for c in format(m, f"0{b - a}b")] for m in range(2 ** (b - a))]
        weight = np.array([np.exp(sum(good[a + i] for i, s in enumerate(y) if s) + sum(stay[u, v] for u, v in zip(y, y[1:]))) for y in states])
        assert np.allclose(p[a:b], (np.array(states) * weight[:, None]).sum(0) / weight.sum())
        assert np.isclose(z[list(first).index(a)], np.log(weight.sum()))
        for y, w in zip(states, weight):
            for u, v in zip(y, y[1:]):
                total[u, v] += w / weight.sum()
    assert np.allclose(pairs, total)
    bad = lambda s: "\n".join(" ".join(w + "###" for w in prose(12, s * 50 + i).split()) for i in range(6))
    fine = lambda s: "\n".join(prose(12, s * 70 + i).capitalize() + "." for i in range(6))
    rows = [(i, fine(i) if i % 4 else bad(i), int(i % 4 > 0)) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows[:120]] + [(None, 1, 0), (500, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_crf.train(docs, labels, max_docs=100)
    got = by_id(quality_crf.scores(docs, model))
    assert np.mean([got[i]["predicted"] == y for i, _, y in rows[120:]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality_crf.scores(odd_docs, model).collect()) and quality_crf.scores(odd_docs, model).count() == 10
    assert quality_crf.scores(no_docs, model).collect() == []
    assert by_id(quality_crf.scores(docs, quality_crf.train(docs, labels.limit(0))))[0]["score"] == 0.5
    again = quality_crf.train(docs.unionByName(docs).unionByName(docs.selectExpr("doc_id", "text || 'z' AS text")), labels, max_docs=100)
    assert np.allclose(again.weights, model.weights)
    assert by_id(quality_crf.scores(docs, quality_crf.train(docs, labels, max_bytes=3)))[0]["score"] == 0.5


def test_op3_languages(spark, odd_docs, no_docs):
    own = {"en": "the of and that with this ing tion", "de": "der die und nicht ein schung keit ung", "fr": "le la est que une eau tion ment", "es": "el los que una ción ado para ñe"}
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(own[k].split(), k=30)), k) for i, k in enumerate(list(own) * 30)] + [(1000, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs.where("doc_id < 80"), per_language=15)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = by_id(language_id.predict(docs, model))
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in rows[80:120]]) > 0.95
    odd = language_id.predict(odd_docs, model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (2, 3, 5, 9)} == dict.fromkeys((2, 3, 5, 9), "und")
    assert len(odd) == 10 and all(0 <= r["score"] <= 1 for r in odd)
    assert language_id.predict(no_docs, model).collect() == []
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(no_docs)).collect()} == {"und"}
    assert set(language_id.label_rows(odd_docs, model).columns) == {*odd_docs.columns, "lang_pred", "lang_score"}


def test_op3_vote_letters_and_repeated_keys(spark):
    """The prediction from the machines' weights by hand; letters beyond U+FFFF; one key in many rows."""
    own = {"en": "the of and that", "de": "der die und nicht", "nl": "het een van niet", "fr": "le la est que", "es": "el los que una"}
    r = random.Random(31)
    data = [(" ".join(r.choices(own[k].split(), k=12)), k) for k in own for _ in range(12)]
    model = language_id.fit([t for t, _ in data], [k for _, k in data])
    sigmoid = lambda v: 1 / (1 + np.exp(-3 * v))
    tests = [" ".join(r.choices(" ".join(own.values()).split(), k=9)) for _ in range(40)]
    for text, lang, score in zip(tests, *model.predict(tests)):
        x = language_id.features([text])[0][0]
        each = {f: sigmoid(x @ model.family_w[:, i] + model.family_b[i]) for i, f in enumerate(model.families)}
        family = max(each, key=each.get)
        members = model.families[family]
        votes = dict.fromkeys(members, 0.0)
        for i, (a, b) in enumerate(model.pairs[family]):
            q = sigmoid(x @ model.pair_w[family][:, i] + model.pair_b[family][i])
            votes[members[a]] += q / (len(members) - 1)
            votes[members[b]] += (1 - q) / (len(members) - 1)
        best = max(votes, key=votes.get)
        assert lang == best and np.isclose(score, each[family] / sum(each.values()) * votes[best], atol=1e-5)
    langs, scores = model.predict(["😀😀 🎉!", "𝒽𝑒 𐐷", "１２", "", "Ⅷ"])
    assert langs[0] == langs[2] == langs[3] == "und" and scores[0] == 0 and langs[1] != "und"
    x, n = language_id.features(["𐐷", "𐐸", "𠀀"])
    assert n.tolist() == [1, 1, 1] and not np.array_equal(x[1], x[2])
    rows = [(1, f"word{i} the of", "en") for i in range(300)] + [(2 + i, t, k) for i, (t, k) in enumerate(data)]
    seen = []
    fit = language_id.fit
    try:
        language_id.fit = lambda texts, langs, families: seen.append(list(zip(langs, texts))) or fit(texts, langs, families)
        language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=10)
    finally:
        language_id.fit = fit
    assert {k: sum(x == k for x, _ in seen[0]) for k in own} == dict.fromkeys(own, 10)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_op4_against_plain_version(spark, odd_docs, no_docs, prose, block_bytes):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [(1, prose(30, 11)), (2, prose(20, 12)), (10, "Short One"), (3, "short one"), (4, ""), (5, None), (6, prose(13, 13)), (None, prose(14, 14)), (6, prose(13, 13))]
    docs = [(i, t) for i, t in texts(odd_docs)] + [
        (100, prose(40, 20) + " " + prose(30, 11).upper() + " " + prose(9, 21)), (101, " ".join(prose(30, 11).split()[5:18])), (102, " ".join(prose(30, 11).split()[5:17])),
        (103, "a SHORT-one b short  one"), (104, prose(13, 13) + " " + prose(13, 13) + " " + prose(14, 14)), (105, (prose(40, 30) + " ") * 9 + prose(20, 12)),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontaminate.contaminated_words(spark, df, bench, block_bytes=block_bytes).collect()
    want = []
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for item, x in items:
            v = low(x)
            k = min(13, len(v))
            for s in range(len(v) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), ",".join(sorted(found))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got), key=str) == sorted(want, key=str)
    out = by_id(decontaminate.contamination(spark, df, bench))
    assert out[104]["items_sha256"] == hashlib.sha256(b",6").hexdigest() and out[103]["n_items"] == 2 and out[101]["contaminated"] and not out[102]["contaminated"]
    kept = decontaminate.drop_contaminated(spark, odd_docs, bench, block_bytes=block_bytes)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    clash = spark.createDataFrame([(i, t, t, i, "s") for i, t in items], "item_id bigint, text string, item string, b bigint, spans string")
    same = by_id(decontaminate.contamination(spark, df, clash))
    assert {k: v["items_sha256"] for k, v in same.items()} == {k: v["items_sha256"] for k, v in out.items()}
    assert decontaminate.contamination(spark, no_docs, bench).collect() == []
    assert all(not r["contaminated"] for r in decontaminate.contamination(spark, odd_docs, bench.limit(0)).collect())


def plain_bpe(ranks, pattern, text):
    """Ids by merging the pair of least rank, the first of equals, until none is left."""
    import regex

    out = []
    for part in regex.findall(pattern, text):
        pieces = [bytes((b,)) for b in part.encode()]
        while True:
            rank, i = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))), default=(1 << 30, 0))
            if rank == 1 << 30:
                break
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        out += [ranks[p] for p in pieces]
    return out


def test_op5_lengths_and_suffix_sums(spark, odd_docs, no_docs):
    counts = token_lengths.count_tokens(odd_docs)
    n = sorted(r["n_tokens"] for r in counts.collect())
    path, pattern = token_lengths.default_tokenizer()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    assert n == sorted(len(plain_bpe(ranks, pattern, t)) for _, t in texts(odd_docs))
    assert len(n) == 10 and n[:2] == [0, 0]
    sums = token_lengths.suffix_sums(token_lengths.stored_histogram(counts), block=16).cache()
    for r in sums.collect():
        k = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert r["truncated_total"] == sum(min(x, k) for x in n) and r["docs_at_most"] == sum(x <= k for x in n)
    for r in token_lengths.for_limits(sums, [0, 1, 50, 10**6]).collect():
        c = r["context_limit"]
        assert (r["n_longer"], r["truncated_total"], r["total_tokens"]) == (sum(x > c for x in n), sum(min(x, c) for x in n), sum(n))
    assert {r["share"]: r["n_tokens"] for r in token_lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect()} == {0.1: n[0], 0.5: n[4], 1.0: n[9]}
    assert token_lengths.suffix_sums(token_lengths.histogram(token_lengths.count_tokens(no_docs))).collect() == []


def test_op6_pages(spark):
    model = html_text.fit(html_text.labelled_pages(160))
    held = html_text.labelled_pages(60, seed=77)
    pages = [html_text.parse(h, labelled=True) for h in held]
    right = total = 0
    for h, p in zip(held, pages):
        m, _ = html_text.Forest.of([p]).marginals(model.weights, model.edges)
        right += sum((m[i] >= 0.5) == bool(p.labels[i]) for i, _, _ in p.leaves)
        total += len(p.leaves)
    assert right / total > 0.95
    # messages give the same marginals as counting all labellings
    p = html_text.parse("<article><h1>T</h1><p>a b</p></article><div class=ad>x</div>")
    f = html_text.Forest.of([p])
    m, _ = f.marginals(model.weights, model.edges)
    n = len(f.parent)
    s = f.x @ model.weights
    weight, good = 0.0, np.zeros(n)
    for k in range(2**n):
        y = [k >> i & 1 for i in range(n)]
        v = np.exp(sum(s[i] for i in range(n) if y[i]) + sum(model.edges[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        weight, good = weight + v, good + v * np.array(y)
    assert np.allclose(m, good / weight, atol=1e-4)
    main = "<article><h1>Title &amp; more</h1><p><b>First  one here.<br><p>Second&nbsp;one, a <i>little</i> longer.</p><script>var t='</p>'</script></article>"
    html = f"<html><head><title>No</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- no <p>x --><div class='ad'>Buy it now.</div>{main}<footer>&copy; all of us</footer></body></html>"
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<p>cut <a href='"), (5, "u", "<" * 3000), (1, "u", html)], "page_id bigint, url string, html string")
    got = html_text.extract(df, model).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Title & more\nFirst one here.\nSecond one, a little longer." and text[2] == text[3] == "" and len(got) == 6
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0), model).collect() == []


def test_op6_untidy_pages(spark):
    model = html_text.fit(html_text.labelled_pages(160))
    said = [f"This is paragraph number {i}, it says a thing or two about nothing at all." for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in said)
    whole = "\n".join(["Title", "One two three four five.", *said])
    page = lambda inner: f"<body><article><h1>Title</h1><p>One two three four five.</p>{inner}</article><footer>&copy; x</footer></body>"
    for inner in (
        f"<a name=top>{body}", f"<a href=/x>{body}", f"<a id=z>{body}<a href=/y>", f"<script src=x.js />var code = 1;</script>{body}", f"<script src=x.js />{body}", f"<STYLE/>p{{}}</style>{body}",
        f"<svg><g>{body}", f"<object><param name=a>{body}", f"<canvas>{body}", f"<select><option>A<option>B{body}", f"<select><option>A</option></select>{body}", f"<template><p>No.</p></template>{body}",
    ):
        assert model.texts([page(inner)])[0] == whole, inner
    flowing = page(f"<p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here, <noscript>no script</noscript> and <svg><path d='M0'/><text>drawn</text></svg> too.</p>{body}")
    assert "We have x=2 here, no script and drawn too.\n" in model.texts([flowing])[0]
    linked = html_text.parse("<div><a href=/x><h3>Teaser</h3><p>More</p></a><p>Plain</p></div>")
    assert [(text, share) for _, text, share in linked.leaves] == [("Teaser", 1), ("More", 1), ("Plain", 0)]
    long = page("".join(f"<p>{x}</p>" for x in said * 20000))
    df = spark.createDataFrame([(1, long, "u", "k", "t", 1, "h"), (2, None, None, None, None, None, None)], "page_id bigint, html string, url string, key string, text string, n_chars int, k0 string")
    got = {r["page_id"]: r for r in html_text.extract(df, model).collect()}
    assert got[1]["text"] == "\n".join(["Title", "One two three four five.", *said * 20000]) and got[2]["text"] == "" and set(got[1].asDict()) == {"page_id", "url", "text", "n_chars"}


def test_op7_as_tiktoken_and_back(odd_docs, no_docs, spark):
    import tiktoken

    path, pattern = token_codec.default_tokenizer()
    vocabulary = token_codec.read_ranks(path)
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={x: i for i, x in enumerate(vocabulary)}, special_tokens={})
    r = random.Random(2)
    more = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), r.randrange(0x1F300, 0x1F700)])) for _ in range(300)) for _ in range(20)]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate([*more, "a" * 5000, "<unk>\u2581 \u2047</s>", "\0\0x"])], "doc_id bigint, text string"))
    ids = token_codec.encode_texts(df)
    plain = {i: enc.encode_ordinary(t) for i, t in texts(df)}
    assert {x["doc_id"]: x["ids"] for x in ids.collect()} == plain
    assert {x["doc_id"]: bytes(x["text"]).decode() for x in token_codec.decode_ids(ids).collect()} == dict(texts(df))
    for x in token_codec.round_trip(df).collect():
        assert x["ids_sha256"] == hashlib.sha256(np.asarray(plain[x["doc_id"]], "<u4").tobytes()).hexdigest() and x["n_tokens"] == len(plain[x["doc_id"]])
        assert x["decoded_sha256"] == hashlib.sha256(dict(texts(df))[x["doc_id"]].encode()).hexdigest()
    assert token_codec.round_trip(no_docs).collect() == []
    small = token_codec.ByteBpe(vocabulary, pattern, cache_parts=3)
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(more)] == [enc.encode_ordinary(t) for t in more]


def test_op8_spans(spark, odd_docs, no_docs):
    assign = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    r = random.Random(4)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(3)]
    rows = [
        (1, f'é Token = "{hexes[0]}" and'), (2, "AKIA" + "Z" * 12 + " AKIASHORT"), (3, "token=abc:secret:longenough1"), (4, f"x{hexes[1]}y ſecret=abcdefghij"), (5, "PASSWD:'p.a.s.s.w.o.r.d'"),
        (6, "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"), (7, "getUserNameFromRequestHandler some/ordinary/path/names-here " + "z" * 40), (8, f"api_key={hexes[2]}"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(secret_scan.scan_texts(df))
    for i, t in rows:
        base = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[1]) >= 8] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0]), x[2]))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), i
    assert got[6]["n_random"] == 1 and got[7]["n_random"] == 0 and got[8]["spans"] == "assign:0:48,hex:8:48"
    assert secret_scan.scan_texts(odd_docs).count() == 10 and secret_scan.scan_texts(no_docs).collect() == []
    clean = {x["doc_id"]: x["text"] for x in secret_scan.redact(df).collect()}
    assert clean[8] == "[SECRET]" and clean[1] == "é [SECRET]\" and" and clean[7] == rows[6][1]
    assert sorted(map(str, texts(secret_scan.redact(odd_docs)))) == sorted(map(str, texts(odd_docs)))
    own = secret_scan.scanner(0.9)
    fresh, ordinary = secret_scan.labelled_samples(seed=99, n=300)
    assert np.mean([own.ratio(x) >= 0.9 for k in ("base62", "base64", "hex") for x in fresh[k]]) > 0.9
    assert np.mean([own.ratio(x) >= 0.9 for x in ordinary if len(x) >= 20]) < 0.02


def test_op10_formats_and_reads_back(spark):
    texts = ["", "</s>[INST] ok [/INST]", "\\<|end|>\n<\\|end|>", "<|turn|>user<|text|>x<|end|>", "[\\\\INST] [INST", "ß😀\n", None]
    rows = [(1, 0, "system", texts[0]), (1, 1, "user", texts[1]), (1, 2, "assistant", texts[2]), (1, 3, "user", texts[3]), (1, 4, "assistant", texts[4])]
    rows += [(2, 0, "assistant", texts[5]), (2, 1, None, texts[6]), (None, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, None, "<|text|>", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = by_id(chat_format.digests(df), "conv_id")
    for c in (1, 2, None, 3, 4):
        own = sorted([(t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c])
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        lost = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()), c
    assert {c: got[c]["valid"] for c in got} == {1: True, 2: False, None: False, 3: False, 4: False}
    assert chat_format.digests(df.limit(0)).collect() == []
    one = chat_format.formatted(chat_format.segments(chat_format.turns_of(df.where("conv_id = 1")))).first()["formatted"]
    assert one.count("<|turn|>") == one.count("<|end|>") == 5 and "[INST]" not in one and "</s>" not in one


def test_op8_every_secret_of_a_run(spark):
    r = random.Random(9)
    some = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choices(a, k=n))
    tokens = [some(40), some(24), some(24), some(28), some(32)]
    plain = "getUserNameFromRequestHandler/some/ordinary/path"
    rows = [
        (1, f"é AKIA{some(16, 'ABCDEFGHIJ234567')}/{tokens[0]} end"), (2, f"{some(40, '0123456789abcdef')}-{tokens[1]}"), (3, f"SOME_LONG_SETTING_NAME_OF_THE_SERVER={tokens[2]}"),
        (4, f"{plain}/{tokens[3]}/{plain}/{tokens[4]}/{plain}"), (5, f"{plain}/{plain} {plain}-AKIA{'Z' * 12}-{plain}"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, clean = by_id(secret_scan.scan_texts(df)), by_id(secret_scan.redact(df))
    assert [got[i]["n_random"] for i in range(1, 6)] == [1, 1, 1, 2, 0]
    for i, hidden in ((1, tokens[:1]), (2, tokens[1:2]), (3, tokens[2:3]), (4, tokens[3:])):
        assert not any(t[k : k + 4] in clean[i]["text"] for t in hidden for k in range(len(t) - 3)), clean[i]
    assert clean[4]["text"].count(plain) == 3 and clean[5]["text"].count(plain) == 4


def test_op3_letters_beyond_the_first_plane():
    _, n = language_id.features(["😀🎉 !!", "𐐀𐐁 😀", "é😀b", ""])
    assert n.tolist() == [0, 2, 2, 0]
    x, _ = language_id.features(["𐐨𐐩𐐪", "𐐫𐐬𐐭", "a😀b", "a b"])
    assert x[0] @ x[1] < 0.5 and np.allclose(x[2], x[3])
    model = language_id.fit(["the of and that", "der die und nicht"] * 5, ["en", "de"] * 5)
    langs, score = model.predict(["😀🎉 !!", "the 😀"])
    assert langs[0] == "und" and score[0] == 0 and langs[1] == "en"


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- x -->", "<!-- x --!>", "<!-- <p>a --> b-->", "<!---->", "<noframes>no</noframes>"])
def test_html_comments_end_where_they_should(comment):
    page = html_text.parse(f"<body><p>one {comment}</p><p>two</p></body>")
    assert [t.replace(" b-->", "") for _, t, _ in page.leaves] == ["one", "two"]


def test_html_of_many_raw_tags_without_ends():
    began = time.perf_counter()
    page = html_text.parse("<body><p>a</p>" + "<script/><style/>" * 100_000 + "<p>b</p>" + "<!" * 1000)
    assert [t for _, t, _ in page.leaves] == ["a", "b"] and time.perf_counter() - began < 20


def test_chat_with_clashing_columns_long_texts_and_long_conversations(spark):
    long_text, many = "</s>[INST] ok [/INST] é" * 20_000, 1500
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", long_text)] + [(2, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(many)]
    df = spark.createDataFrame([(*r, "x", ["y"], "z", True) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, segments array<string>, turns string, valid boolean").repartition(3)
    got = by_id(chat_format.digests(df), "conv_id")
    assert got[1]["loss_chars"] == len(long_text) and got[1]["loss_sha256"] == hashlib.sha256(long_text.encode()).hexdigest()
    said = "".join(f"{('user', 'assistant')[i % 2]}\nt{i}\n" for i in range(many))
    assert got[2]["n_turns"] == many and got[2]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[2]["valid"]
