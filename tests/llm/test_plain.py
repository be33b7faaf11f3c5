"""Corpus operators without Spark: round trips, brute force, held-out accuracy."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ploidlens.llm import html, idfiles, jaccard, langid, packing, pii, quality, webp
from ploidlens.llm.tokens import Encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet=" \n\t'aAéß19_.|,sl", max_size=80)), max_size=6))
@settings(max_examples=80, deadline=None)
def test_ids_equal_the_library(name, texts):
    e = Encoder.of(public_tokenizers.path(name))
    ids, n = e.ids(texts)
    got = np.split(ids, np.cumsum(n)[:-1]) if texts else []
    for g, t in zip(got, texts):
        assert g.tolist() == e.tok.encode(t or "", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(0, 3))
@settings(max_examples=30, deadline=None)
def test_coder_round_trip(ids, k):
    x = np.array(ids * (1, 1, 3, 40)[k], np.uint32)
    if len(x):
        assert (idfiles.decode(idfiles.encode(x, 301), len(x), 301) == x).all()


def test_block_is_checked():
    x = np.arange(500, dtype=np.uint32) % 50
    b = idfiles.write_block(np.array([1, 2]), np.array([False, True]), np.array([200, 300]), x, 7)
    d, null, n, y, before = idfiles.read_block(b)
    assert (d.tolist(), null.tolist(), n.tolist(), before) == ([1, 2], [False, True], [200, 300], 7) and (x == y).all()
    with pytest.raises(ValueError):
        idfiles.read_block(b[:100] + bytes([b[100] ^ 1]) + b[101:])


def _best(sizes, cap):
    """The fewest bins, by search over assignments."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= cap:
                place(k + 1, bins[:j] + [bins[j] + sizes[k]] + bins[j + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_packing_is_optimal_on_small_cases(sizes):
    plan = packing.complete(np.bincount(sizes, minlength=21), 20)
    assert sorted(x for m, f in plan for x in f * m) == sorted(sizes)
    assert all(sum(f) <= 20 for _, f in plan)
    assert sum(m for m, _ in plan) == _best(sizes, 20)


@pytest.mark.parametrize("counts", [{1: 5000}, {2: 7000, 1: 3}, {5: 40000, 1: 3, 700: 90}, {3: 10000, 4: 10000, 5: 10000}, {1: 30000, 2043: 10, 900: 50}, {4: 50000} | {k: 20 for k in range(20, 2048, 7)}])
def test_many_short_pieces_fill_their_sequences(counts):
    count = np.zeros(2049, np.int64)
    count[list(counts)] = list(counts.values())
    plan = packing.complete(count, 2048)
    got = np.zeros(2049, np.int64)
    for m, f in plan:
        got += m * np.bincount(f, minlength=2049)
        assert sum(f) <= 2048
    assert (got == count).all()
    assert sum(m for m, _ in plan) == packing.bound(count, 2048)


def test_a_dominated_filling_is_left_out():
    count = np.bincount([3, 3, 4, 7], minlength=11)
    assert packing.fillings(10, count, 10, want=9) == [[7, 3], [4, 3, 3]]
    assert packing.fillings(9, count, 10, want=9) == [[7], [4, 3]]  # not [3, 3], where 4 fits for a 3


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (0, 1, 2), (2, 1, 0), (3,), (3, 0)])
@pytest.mark.parametrize("cache,runs", [(0, False), (5, True)])
def test_webp_round_trip(transforms, cache, runs):
    rng = np.random.default_rng(1)
    for colours in (1, 2, 4, 13, 200) if 3 in transforms else (300,):
        x = rng.integers(0, 1 << 32, colours, dtype=np.uint32)[rng.integers(0, colours, (11, 19))]
        x[4:7] = x[4, 0]
        d = webp.encode(x, transforms, cache, runs)
        assert (webp.decode(d) == x).all() and (webp.decode_many([d, d])[1] == x).all()
    with pytest.raises(ValueError):
        webp.decode(d[: len(d) // 2])


@given(st.lists(st.one_of(st.none(), st.text(max_size=200)), max_size=8))
@settings(max_examples=30, deadline=None)
def test_media_round_trip(texts):
    p = [webp.payload(t)[0] for t in [*texts, "ab" * 30_000]]
    assert [webp.samples(x) for x in webp.images_of(webp.media_of(p))] == p
    assert all(len(x) % 64 == 0 and len(x) for x in p)


def test_damage_and_other_chunks():
    x = np.arange(12, dtype=np.uint32).reshape(3, 4) | np.uint32(0xFF000000)
    d = webp.encode(x, (2,), 3, True)
    wide = d[:12] + b"VP8X" + (10).to_bytes(4, "little") + bytes(10) + b"ICCP" + (3).to_bytes(4, "little") + bytes(4) + d[12:]
    wide = wide[:4] + (len(wide) - 8).to_bytes(4, "little") + wide[8:]
    assert (webp.decode(wide) == x).all()
    rng = np.random.default_rng(3)
    for _ in range(400):
        k = int(rng.integers(8 * 20, 8 * len(d)))
        b = bytearray(d)
        b[k // 8] ^= 1 << k % 8
        try:
            webp.decode(bytes(b))
        except ValueError:
            pass
    flat = webp.payload("ab" * 300)[0]
    m = webp.media_of([flat, webp.payload(None)[0]])
    assert [webp.samples(i) for i in webp.images_of(m)] == [flat, bytes(64)] and len(m[0]) < len(webp._encode_some([flat])[0])


def _forms(files):
    """Of each file: the kinds of its transforms, and whether its code has back-references."""
    out = []
    for d in files:
        r, w, _, h, transforms = webp._opened(d)
        out.append(([t[0] for t in transforms], int(webp._entropy(r, w, h, True)[3][0][0][0].max()) >> 4 > 255))
    return out


def test_media_of_any_payload_has_the_steps_that_shorten_it():
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(3, 9, 200)]
    prose = webp.payload(" ".join(words[k] for k in rng.integers(0, 200, 2000)))[0]
    smooth = (np.cumsum(rng.integers(-2, 3, 64 * 200)) % 256).astype(np.uint8).tobytes()
    again = bytes(rng.integers(0, 256, 6400, dtype=np.uint8)) * 2  # one reference beyond the longest
    noise = bytes(rng.integers(0, 256, 6400, dtype=np.uint8))
    p = [prose, smooth, again, noise, b"abcd" * 16, bytes(64)]
    files = webp.encode_many(p)
    assert [webp.samples([webp.decode(d)]) for d in files] == p == [webp.samples([x]) for x in webp.decode_many(files)]
    forms = _forms(files)
    assert forms[0] == ([webp.SUBTRACT], True) and forms[2] == ([webp.SUBTRACT], True)
    assert forms[1][0] == [webp.SUBTRACT, webp.PREDICTOR] and forms[3] == ([webp.SUBTRACT], False)
    literals = webp._encode_some(p)
    assert len(files[0]) < 0.8 * len(literals[0]) and len(files[1]) < 0.6 * len(literals[1]) and len(files[2]) < 0.52 * len(literals[2])
    assert len(files[3]) == len(literals[3])
    assert (webp.decode(files[0]) >> 16 & 255 == webp.decode(files[0]) & 255).all()  # grey


def test_a_file_does_not_depend_on_what_is_encoded_with_it():
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 113, n))) for n in rng.integers(1, 7, 60)]
    p = [webp.payload(" ".join(words[k] for k in rng.integers(0, 60, n)))[0] for n in rng.integers(1, 3000, 60)]
    files = webp.encode_many(p)
    assert files == [webp.encode_many([x])[0] for x in p] == webp.encode_many(p[::-1])[::-1]


def test_each_predictor_is_undone():
    rng = np.random.default_rng(6)
    x = np.uint32(0xFF000000) | rng.integers(0, 256, (9, 64), dtype=np.uint32) << np.uint32(8)
    for mode in range(14):
        modes = np.full((3, 16), mode, np.uint32)
        r = webp.predicted(x, modes, 2, False)
        assert not (r & 0xFFFF00FF).any() and (webp.predicted(r, modes, 2, True) == x).all()


@given(st.lists(st.lists(st.sampled_from([b"a", b"bc", b"the same again ", bytes(range(40)), b"\0" * 70, b"xyz" * 50]), max_size=30).map(b"".join), min_size=1, max_size=6), st.integers(0, 3000))
@settings(max_examples=40, deadline=None)
def test_references_by_many_and_by_one(parts, k):
    p = [webp.payload(x.decode())[0] for x in parts]
    files = webp.encode_many(p)
    one = [webp.decode(d) for d in files]
    assert [webp.samples([x]) for x in one] == p and all((x == y).all() for x, y in zip(one, webp.decode_many(files)))
    b = bytearray(max(files, key=len))
    b[21 + k % (len(b) - 21)] ^= 1 << k % 8
    try:
        webp.decode_many([bytes(b), *files])
    except ValueError:
        pass


def _plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda x: (pii.KINDS.index(x[0]), x[1]))


@given(st.text(alphabet="a.@+ -()0149%\n", max_size=120))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_plain_patterns(t):
    assert [x[:3] for x in pii.spans(t) if x[0] in pii.BASE] == _plain_spans(t)


def test_pii_checks_and_context():
    t = 'IBAN DE89 3704 0044 0532 0130 00, card 4111 1111 1111 1111, mail a.b@c.org, ssn 123-45-6789, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    assert {x[0] for x in pii.spans(t)} == {"iban", "card", "email", "ssn", "secret"}
    assert not pii.spans("123-45-6789 DE88 3704 0044 0532 0130 00 4111 1111 1111 1112")
    assert "@" not in pii.redact(t) and "[EMAIL]" in pii.redact(t) and pii.redact(None) is None and pii.spans("1" * 100_000 + "@" * 1000) is not None


@pytest.mark.parametrize("after", ["", " BIC COBADEFF", " 1000 EUR", " AB", ", 12", " Bank", " 1 2 3 4 5 6 7 8 9"])
@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"])
def test_iban_ends_before_what_follows(iban, after):
    t = f"Konto {iban}{after}"
    assert [t[s:e] for k, s, e, _ in pii.spans(t) if k == "iban"] == [iban]


@pytest.mark.parametrize("size", [16, 200, 201, 5000])
def test_long_secrets_are_redacted_whole(size):
    key = ("aB3_-.x9" * 700)[:size]
    assert pii.redact(f"token = {key} end") == "token = [SECRET] end"


def _plain_base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    cover = {k + j for k, w in enumerate(win) if win.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


@given(st.text(alphabet="ab#é \n\t", max_size=100))
@settings(max_examples=200, deadline=None)
def test_quality_features(t):
    assert quality.base_features(t) == _plain_base(t)


@pytest.mark.parametrize("num", [80, 90])
def test_jaccard_prefixes_lose_no_link(num):
    rng = np.random.default_rng(num)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = []
    for n in (1, 2, 5, 10, 24, 60, 300):
        for _ in range(8):
            a = np.unique(rng.choice(pool, n))
            sets.append(a)
            for _ in range(4):
                b = rng.permutation(a)[rng.integers(0, 1 + len(a) * (100 - num) // 100) :]
                sets.append(np.unique(np.concatenate([b, rng.choice(pool, rng.integers(0, 1 + len(a) // 10))])))
    sets = list({x.tobytes(): x for x in sets if len(x)}.values())
    h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, often = np.unique(h, return_inverse=True, return_counts=True)
    often, size = often[at], np.array([len(x) for x in sets])
    use = np.flatnonzero(often > 1)
    first = use[jaccard.prefix(own[use], often[use], h[use], size, np.zeros(len(sets), np.int64), num, 100)]
    keys = [set(h[first[own[first] == k]].tolist()) for k in range(len(sets))]
    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            o = len(np.intersect1d(a, b))
            if 100 * o >= num * (len(a) + len(b) - o):
                links += 1
                assert keys[i] & keys[j]
    assert links > 50


def test_overlap_product():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    assert (jaccard.overlaps(sets[:25], sets[10:]) == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:25]]).all()


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    e, tn, s = rng.normal(size=(200, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    ends = np.array([1, 65, 66, 200])
    got = langid.marginals(e, tn, s, ends)
    for a, b in zip([0, *ends], ends):
        x, n = e[a:b], b - a
        al, be, m = np.zeros((n, 3)), np.ones((n, 3)), np.exp(tn)
        al[0] = np.exp(s + x[0])
        for t in range(1, n):
            al[t] = al[t - 1] @ m * np.exp(x[t])
            al[t] /= al[t].sum()
        for t in range(n - 2, -1, -1):
            be[t] = m @ (np.exp(x[t + 1]) * be[t + 1])
            be[t] /= be[t].sum()
        p = al * be
        assert np.allclose(got[a:b], p / p.sum(1, keepdims=True))


def test_language_accuracy_on_held_out_documents():
    rows = duckdb.sql("SELECT doc_id, lang, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    out = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    train = [r for r, o in zip(rows, out) if not o]
    t = langid.Tagger(sorted({r[1] for r in train})).fit([langid.words_of(r[2])[:120] for r in train], [r[1] for r in train])
    test = [r for r, o in zip(rows, out) if o]
    lang, _ = t.predict([r[2] for r in test])
    assert np.mean([a == r[1] for a, r in zip(lang, test)]) > 0.98
    assert t.predict([None, "", "12 !"])[0] == ["und"] * 3


PAGE = """<html><head><title>t</title></head><body><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=x>a</a></li></ul></nav><div class="cookie-notice">We use cookies ok</div>
<div id="content"><h1>Title &amp; all</h1><div class="advertisement">Buy now</div><p>First <i>para</i>graph&nbsp;here
with words enough.</p><aside>Side</aside><p>Second paragraph with words, <a href=x>linked</a> too.</p><form><p>Sign up</p></form><ul><li>item one</li><li>item two</li></ul></div>
<section class="comments"><p>Great post, a very long comment that has many many words in it and goes on and on.</p></section><footer>c</footer>"""


def test_long_runs_of_letters_count_whole():
    w = "".join(chr(0x4E00 + k) for k in range(500))
    parts = langid.words_of(f"ab {w}, {w[:24]} {w[:25]}")
    assert max(map(len, parts)) == 24 and parts[0] == "ab" and parts[-3:] == [w[:24], w[:24], w[22:25]]
    assert {w[k : k + 3] for k in range(498)} == {p[k : k + 3] for p in parts[1:-3] for k in range(len(p) - 2)}
    rng = np.random.default_rng(1)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = [("x", run("abcdef", 400)) for _ in range(20)] + [("y", run("uvwxyz", 400)) for _ in range(20)]
    tagger = langid.Tagger(["x", "y"]).fit([langid.words_of(t) for _, t in texts], [x for x, _ in texts])
    assert tagger.predict([run("abcdef", 24) + run("uvwxyz", 400), run("uvwxyz", 24) + run("abcdef", 400)])[0] == ["y", "x"]


@pytest.mark.parametrize("menu", ['<nav>{}</nav>', '<div class="related"><ul>{}</ul></div>', '<aside><div>{}</div></aside>'])
def test_long_menus_do_not_cut_an_article(menu):
    words = "one reads here what the writer of this long and quiet story has to say about it all".split()
    part = lambda n, w: " ".join([w, *(words[k % len(words)] for k in range(n))])
    links = "".join(f'<li><a href="/{k}">more {k}</a></li>' for k in range(200))
    page = f"<html><body><div><article><h1>{part(5, 'Head')}</h1><p>{part(60, 'First')}</p>{menu.format(links)}<p>{part(50, 'Second')}</p></article></div></body></html>"
    assert html.extract(page) == "\n".join([part(5, "Head"), part(60, "First"), part(50, "Second")])


def test_names_of_headings_and_sections_do_not_lose_text():
    words = "some words of an article that are read"
    page = f'<body><article><h2 id="search">Search in trees</h2><p class="notice">Take {words}</p><section id="discussion"><p>We {words}</p></section><p>Energy is <math><mi>E</mi></math> as shown</p><div class="notice">Cookies</div><p>{words}</p></article></body>'
    assert html.extract(page) == f"Search in trees\nTake {words}\nWe {words}\nEnergy is E as shown\n{words}"


@given(st.lists(st.sampled_from(["a b c ", "word ", "<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<ul>", "<li>", "<br>", "<h2>", "</h2>"]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_the_scan_finds_the_best_of_all_regions(parts):
    seq = list(html.tokens("".join(parts)))
    gain = [html.WEIGHTS[k] * len(t.split()) if t and kept else html.WEIGHTS.get(k, html.UNSEEN) if kept and not t else 0.0 for k, t, _, kept in seq]
    best = max((sum(gain[a:b]) for a in range(len(seq)) for b in range(a + 1, len(seq) + 1)), default=0.0)
    a, b = html.region(seq)
    assert abs(sum(gain[a:b]) - max(best, 0.0)) < 1e-9


def test_weights_from_marked_pages():
    found = html.marked("<body><nav><ul><li><a href=x>one</a></li></ul></nav><article><p>many words are here to read</p></article></body>")
    w = html.fit(found)
    assert w["word"] > 0 > w["li"] and html.marked("<p>no mark") == []


def test_main_text():
    assert html.extract(PAGE) == "Title & all\nFirst paragraph here with words enough.\nSecond paragraph with words, linked too.\nitem one\nitem two"
    assert html.extract(None) == html.extract("") == html.extract("<p>") == ""
    assert html.extract("only text") == "only text" and html.extract('<div class="a>b</div>') == "b"
    random.seed(1)
    for _ in range(200):
        html.extract("".join(random.choice(["<", ">", '"', "<p>", "</div>", "<!--", "a b", "<script", "&amp", "<div class=ad>"]) for _ in range(30)))


@given(st.lists(st.text(alphabet="ab \U0001f600é\0", min_size=1, max_size=40), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_distinct_grams(texts):
    flat, at = quality.codes(texts, 3)
    h, gram, n = quality.distinct(flat, at, 3)
    want = {}
    for t in texts:
        t = f"  {t} "
        for k in range(len(t) - 2):
            want[t[k : k + 3]] = want.get(t[k : k + 3], 0) + 1
    assert {"".join(map(chr, g)): c for g, c in zip(gram.tolist(), n.tolist())} == want
    look = quality.Sorted(h, n)
    assert look.look_up(quality.hashes(flat, at, 3)).tolist() == [want["".join(map(chr, flat[k : k + 3]))] for k in at]


def test_expectations_equal_enumeration():
    rng = np.random.default_rng(7)
    e, tn, s = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, pairs = np.zeros((2, 4, 3)), np.zeros((3, 3))
    for n in range(2):
        weight = {y: np.exp(s[y[0]] + sum(e[n, t, v] for t, v in enumerate(y)) + sum(tn[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product(range(3), repeat=4)}
        total = sum(weight.values())
        for y, w in weight.items():
            for t, v in enumerate(y):
                p[n, t, v] += w / total
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / total
    got = langid.expected(e, tn, s)
    assert np.allclose(got[0], p) and np.allclose(got[1], pairs)
