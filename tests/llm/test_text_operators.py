"""Operators that work text by text: no Spark needed for most of it."""

import re
import textwrap

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillion.llm import decontaminate as dec
from quillion.llm import licenses, neardup, pieces, quality, toxicity, warc
from quillion.llm.features import BLOCK, blocks

MODEL = pieces.default_model()


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return f.read()


TEXTS = ["", " ", "  a  b ", "Hello  world\nfoo\tbar é", "▁a▁▁b", "ゼ 執x \U0001f600", "a" * 200, "<s> </s> <0x0A> <unk>", "¥　\r\n", "one " * 50]


def test_pieces_without_dropout_equal_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    p = pieces.Pieces(model, 1, 0.0, 1)
    for t, ids in zip(TEXTS, p.encode(TEXTS), strict=True):
        if pieces.MARK not in t:
            assert ids.tolist() == sp.encode(t)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_pieces_decode_to_every_text(texts):
    with open(MODEL, "rb") as f:
        p = pieces.opened(f.read(), 3, 0.3, 2)
    assert [p.decode(i) for i in p.encode(texts)] == texts


def test_dropout_is_keyed_and_agendas_agree(model):
    a, b, c = (pieces.Pieces(model, seed, 0.3, 2) for seed in (5, 5, 6))
    texts = ["representation learning of unbelievable words " * 3, *TEXTS, None]
    x, y, z = a.encode(texts), b.encode(texts[::-1])[::-1], c.encode(texts)
    assert all((i is None and j is None) or i.tolist() == j.tolist() for i, j in zip(x, y, strict=True))
    assert x[0].tolist() != z[0].tolist() and x[-1] is None and a.decode(None) is None
    for t in texts[:-1]:
        for chunk in {w for w in a.split(t) if 1 < len(w) <= pieces.LONG}:
            assert a.chunks(1, [chunk]) == [a.chunk_slow(1, chunk)]


def test_every_occurrence_of_a_chunk_has_its_own_draws(model):
    rate, word = 0.1, " representation"
    p = pieces.Pieces(model, 5, rate)
    (chunk,) = set(p.split(word * 2)[1:])
    _, steps = p.advanced(p.symbols_of([chunk]), None)
    place, piece = (np.concatenate(x) for x in list(zip(*steps, strict=True))[1:])
    (usual,) = pieces.Pieces(model, 5, 0.0).chunks(0, [chunk])

    def varied(texts):
        keys, got = [], []
        for t in texts:
            parts = p.split(t)
            at = p.keys_of(t, len(parts))
            here = [k for k, c in enumerate(parts) if c == chunk]
            keys += at[here].tolist()
            got += [x for k, x in enumerate(p.chunks(at, parts)) if parts[k] == chunk]
        return np.array(keys, np.uint64), got

    # within one text, and at one place of many texts
    for keys, got in (varied([word * 20001]), varied([f"w{k}{word}" for k in range(5000)])):
        assert len(set(got)) > 50 and len(got) >= 5000
        # each merge is skipped at the rate, independently; without any skip the ids are the usual ones
        skipped = np.array([p.skips(keys, a, i) for a, i in zip(place, piece, strict=True)])
        assert (abs(skipped.mean(1) - rate) < 0.02).all() and abs((~skipped.any(0)).mean() - (1 - rate) ** len(place)) < 0.02
        assert {got[k] for k in np.flatnonzero(~skipped.any(0))} == {usual}
    # the same as with an agenda for each occurrence, however often a chunk is met and whatever the cache holds
    text = "the learning of unbelievable representation learning words " * 40
    parts = p.split(text)
    keys = p.keys_of(text, len(parts))
    want = [p.chunk_slow(k, c) if 1 < len(c) else p.chunks(0, [c])[0] for k, c in zip(keys, parts, strict=True)]
    assert p.chunks(keys, parts) == want
    p.clear()
    assert p.chunks(keys, parts) == want and p.encode([text])[0].tobytes() == b"".join(want)
    assert pieces.Pieces(model, 5, rate, 1).encode([text])[0].tobytes() != b"".join(want)


def test_arc_versions_and_lengths():
    v1 = b"filedesc://x 0.0.0.0 20240101 text/plain 10\n1 0 Some\nX\n"
    rec = b"http://a.b/c d 1.2.3.4 20240203040506 text/html 5\nhel\nl\n"
    got = list(warc.parse_arc(v1 + rec + b"http://e/ 1.1.1.1 2024 text/html 99\nshort"))
    assert [(r["url"], r["payload"], r["error"]) for r in got] == [("http://a.b/c d", b"hel\nl", None), ("http://e/", None, "cut off")]
    v2 = b"filedesc://x 0.0.0.0 20240101 text/plain 4\n2 0 \n\nhttp://e/ 1.1.1.1 2024 text/html 200 - - 0 f.arc 2\nhi\n"
    assert [(r["version"], r["url"], r["payload"]) for r in warc.parse_arc(v2)] == [(2, "http://e/", b"hi")]
    assert list(warc.parse_arc(b"")) == [] and [r["error"] for r in warc.parse_arc(b"nonsense\n")] == ["malformed header line"]
    assert warc.warc_date("20240203040506") == "2024-02-03T04:05:06Z" and warc.warc_date("2024") == "2024-01-01T00:00:00Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"


def test_arc_records_after_a_broken_one_are_kept():
    v1 = b"filedesc://x 0.0.0.0 20240101 text/plain 10\n1 0 Some\nX\n"
    good = [b"http://a/%d 1.2.3.4 20240203040506 text/html 5\nhel\nl\n" % k for k in range(3)]
    for bad, error in ((b"http://b/ 1.2.3.4 2024 text/html x5\nhel 5\nl\n", "malformed header line"), (b"http://b/ 1.2.3.4 20240203040506 text/html 9999\nhello\n", "cut off")):
        got = list(warc.parse_arc(v1 + good[0] + bad + good[1] + good[2]))
        assert [(r["url"], r["payload"]) for r in got] == [("http://a/0", b"hel\nl"), ("http://b/", None), ("http://a/1", b"hel\nl"), ("http://a/2", b"hel\nl")]
        assert [r["error"] for r in got] == [None, f"{error}; {len(bad)} bytes skipped", None, None] and [r["ordinal"] for r in got] == [0, 1, 2, 3]
    v2 = b"http://e/%d 1.1.1.1 20240203040506 text/html 200 - - 0 f.arc 2\nhi\n"
    assert [(r["version"], r["payload"]) for r in warc.parse_arc(b"filedesc://x broken\n" + v2 % 0 + v2 % 1)][1:] == [(2, b"hi")] * 2


def test_wu_manber_equals_brute_force():
    rng = np.random.default_rng(0)
    text = lambda n: " ".join(rng.choice(list("abcd"), n))
    items = [(str(i), text(int(n))) for i, n in enumerate(rng.integers(0, 14, 25))] + [("n", None), ("e", "?!")]
    known = [(i, dec.words(None if t is None else t.encode())) for i, t in items]
    for window in (1, 3, 10):
        by = dec.matchers(known, window)
        for t in [None, "", "?", *(text(int(n)).upper() for n in rng.integers(1, 200, 12)), items[3][1]]:
            ws = dec.words(None if t is None else t.encode())
            spans, ids = dec.search(ws, by)
            assert (len(ws), sum(e - s for s, e in spans), len(ids)) == dec.brute(t, items, window)[:3]


def test_words_are_those_of_the_contract():
    t = "Ab-9 É_x y Z\x7fq"
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    assert [w.decode() for w in dec.words(t.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_license_scan_equals_comparing_all():
    t = licenses.Templates(licenses.TEMPLATES)
    assert t.scan(None) == t.scan("") == t.scan("word") == []
    mit = licenses.TEMPLATES["MIT"]
    lines = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    texts = [f"Some text.\n{licenses.TEMPLATES['Apache-2.0/notice']}\nmore", f"intro\n\n{lines}\n\nend", mit.upper(), "this work is licensed under the gnu general public license version 3 indeed", "all rights are mine\nreserved"]
    for x in texts:
        segs = x.split("\n")
        want = set()
        runs = [(i, i + 1) for i in range(len(segs))] + [(0, len(segs))]
        start = 0
        for i in range(len(segs) + 1):
            if i == len(segs) or not segs[i].strip():
                runs += [(start, i)] if i > start else []
                start = i + 1
        for a, b in runs:
            w = re.findall(r"[^\W_]+", " ".join(segs[a:b]).lower())
            top = max(((licenses.dice(licenses.bigrams(w), g), name) for _, name, g in t.by_size), key=lambda d: (d[0], [-ord(c) for c in d[1]]))
            if len(w) > 1 and top[0] >= licenses.LEAST:
                want.add((a, b, round(top[0], 9), top[1]))
        assert {(a, b, round(d, 9), n) for a, b, d, n in t.scan(x)} == want
    assert {m[3] for m in t.scan(texts[0])} == {"Apache-2.0/notice"} and "MIT" in [m[3] for m in t.scan(texts[1])]


def in_paragraphs(name, starts, width=70):
    """The lines of a template, with a blank line before each of ``starts``."""
    text = licenses.TEMPLATES[name]
    for w in starts:
        text = text.replace(w, f"\n\n{w}")
    return "\n".join(line for p in text.split("\n") for line in (textwrap.wrap(p, width) or [""]))


@pytest.mark.parametrize(
    "name, starts",
    [
        ("MIT", ["The above copyright", "THE SOFTWARE IS PROVIDED"]),
        ("BSD-2-Clause", ["1. Redist", "2. Redist", "THIS SOFTWARE IS"]),
        ("BSD-3-Clause", ["1. Redist", "2. Redist", "3. Neither", "THIS SOFTWARE IS"]),
    ],
)
def test_licenses_of_several_paragraphs_inside_long_texts(name, starts):
    t = licenses.Templates(licenses.TEMPLATES)
    lines = in_paragraphs(name, starts).split("\n")
    rng = np.random.default_rng(len(name))
    filler = [" ".join(f"w{k}" for k in rng.integers(0, 500, 12)) for _ in range(60)]
    for before, after in ((filler[:30], filler[30:]), ([*filler[:30], ""], ["", *filler[30:]]), ([], [])):
        got = t.scan("\n".join([*before, *lines, *after]))
        assert (len(before), len(before) + len(lines), 1.0, name) in got
        assert {m[3].split("/")[0] for m in got} == {name}
    # two licences, one after the other, and one line for each word
    got = t.scan("\n".join([*filler, *lines, "", *filler, *lines]))
    assert [m[:2] for m in got if m[3] == name] == [(60, 60 + len(lines)), (121 + len(lines), 121 + 2 * len(lines))]
    assert name in [m[3] for m in t.scan("\n".join([*filler, *" ".join(lines).split(), *filler]))]


def test_other_runs_of_lines_equal_comparing_all():
    t = licenses.Templates({"A": "a b c d e f g h", "A/x": "a b c", "B": "h g f e a b"})
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = "\n".join(" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 4))) for _ in range(8))
        text = text.replace("a b", "a b c\nd e\n\nf g")
        lines = text.split("\n")
        words, ends = [], [0]
        for x in lines:
            words += x.split()
            ends.append(len(words))
        want = {}
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                if ends[b] - ends[a] > 1 and lines[a] and lines[b - 1]:
                    w = licenses.bigrams(words[ends[a] : ends[b]])
                    d, name = min((-licenses.dice(w, g), name) for _, name, g in t.by_size)
                    if -d >= licenses.LEAST:
                        want[a, b] = (round(-d, 9), name)
        hits = [i for i, g in enumerate(zip(words, words[1:])) if g in t.known]
        got = {(a, b): (round(d, 9), n) for a, b, d, n in t.runs(words, ends, hits, set())} if hits else {}
        assert got.items() <= want.items()
        # the best of each template are never passed over
        for name in t_names(want):
            top = max(d for d, n in want.values() if n == name)
            assert any(g == (top, name) for g in got.values())


def test_notices_amid_other_words():
    t = licenses.Templates(licenses.TEMPLATES)
    assert t.scan("My code. Released under the MIT License. See the docs for more of the same.") == [(0, 1, 1.0, "MIT/notice")]
    text = "a b c\nwe say that this picture is licensed under CC BY-SA 4.0 or later, as\nyou like; all rights reserved by us and them and others\nx"
    assert t.scan(text) == [(1, 2, 1.0, "CC-BY-SA-4.0/short")]
    # brute force: every stretch of a template's length, the best of those that overlap
    t = licenses.Templates({"A": "a b c d e f", "B": "c d e f g h i", "C": "a b"})
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = [*rng.choice(list("abcdefghixyz"), rng.integers(0, 6)), *"abcdef"[: rng.integers(3, 7)], *"cdefghi"[rng.integers(0, 3) :], *rng.choice(list("abcxyz"), 4)]
        hits = [i for i, g in enumerate(zip(words, words[1:])) if g in t.known]
        best = {}
        for size, name, grams in t.by_size:
            if size >= licenses.LEAST_WINDOW:
                for i in range(len(words) - 1):
                    d = sum((licenses.bigrams(words[i : i + size + 1]) & grams).values()) / size
                    best[name] = max(best.get(name, 0), d)
        got = t.windows(words, hits)
        assert all(d >= licenses.LEAST and abs(sum((licenses.bigrams(words[s:e]) & dict((n, g) for _, n, g in t.by_size)[name]).values()) / dict((n, z) for z, n, _ in t.by_size)[name] - d) < 1e-9 for s, e, d, name in got)
        top = max(best.values())
        assert (max((d for _, _, d, _ in got), default=0) == top) if top >= licenses.LEAST else not got


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"])
def test_whole_license_files(name):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not (folder / name).is_file():
        pytest.skip("no folder of licence texts here")
    t = licenses.Templates(licenses.templates_of(str(folder)))
    text = "Copyright 2020 Somebody. All rights reserved.\n\n" + (folder / name).read_text("utf-8", "replace")
    top = max(t.scan(text), key=lambda m: (m[1] - m[0], m[2]))
    assert top[3] == name and top[2] > 0.98


def t_names(want):
    return {n for _, n in want.values()}


def test_shingles_are_exact_across_blocks():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 5, 6, 300):
        t = " \n".join(rng.choice(["Aé", "b", "c d", "e"], n)) if n else " \t"
        assert len(neardup.shingle_set(t.encode())) == len(brute(t))
    word = "x" * (BLOCK - 3)
    long = f"a b {word}yz{word} c d e {word}yz{word} c d"
    assert len(neardup.shingle_set(long.encode())) == len(brute(long))
    assert neardup.word_hashes(b"ab cd")[1] == neardup.word_hashes(b"cd")[0] and len(neardup.shingle_set(None)) == 0


def test_exact_links_of_blocks():
    rng = np.random.default_rng(2)
    base = rng.choice(10**9, 100, replace=False)
    sets = [np.unique(np.r_[base[: 100 - k], rng.choice(10**9, k)]) for k in range(0, 40, 2)]
    comps, side = np.arange(len(sets)), np.zeros(len(sets), int)
    pairs = neardup.exact_links(sets, comps, side, 75)
    j = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert all(j(sets[a], sets[b]) >= 0.75 for a, b in pairs)
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for k in range(i):
            if j(sets[i], sets[k]) >= 0.75:
                label = [min(label[i], label[k]) if x in (label[i], label[k]) else x for x in label]
    mine = list(range(len(sets)))
    for a, b in pairs:
        mine = [min(mine[a], mine[b]) if x in (mine[a], mine[b]) else x for x in mine]
    assert mine == label


def test_blocks_cover_whole_texts():
    texts = [None, "", "ab cd " * 5, "x" * 37]
    got = {}
    for which, parts in blocks(texts, 10):
        for i, p in zip(which, parts, strict=True):
            got[i] = got.get(i, "") + p
    assert got == {2: texts[2], 3: texts[3]}


def test_quality_learns_and_scores_any_text():
    good, bad = [f"the river runs past town number {i} today" for i in range(60)], [f"$$$ win%%% now### {i}***" for i in range(60)]
    rows = []
    for t, y in [*((t, 1) for t in good[:40]), *((t, 0) for t in bad[:40])]:
        at, n = np.unique(quality.buckets([t])[1], return_counts=True)
        rows.append((at, n.astype(float), y))
    table, bias = quality.train(rows, {0: 40, 1: 40})
    s = quality.score_texts([*good[40:], *bad[40:], None, "", "x" * 10], table, bias)
    assert s[:20].min() > 0.5 > s[20:40].max() and s[40] == s[41] and np.isfinite(s).all()
    long = " ".join(good) * 3
    assert abs(quality.score_texts([long], table, bias)[0] - quality.score_texts(["", long, None], table, bias)[1]) < 1e-12


def test_counterfactuals_take_the_weight_off_identity_terms():
    toxic = [f"those muslims are scum number{i}" for i in range(60)] + [f"you scum word{i}" for i in range(20)]
    clean = [f"a{i} nice{i} day{i} for{i} everyone{i}" for i in range(80)]
    rows, y = toxicity.present(toxic + clean), np.repeat([1, 0], 80)
    plain, held = toxicity.train(rows, y, swap_weight=0.0), toxicity.train(rows, y)
    neutral, swapped = "the muslims met at noon", "the christians met at noon"
    gap = lambda m: abs(np.subtract(*toxicity.score_texts([neutral, swapped], *m)))
    assert gap(held) < 0.1 * gap(plain)
    s = toxicity.score_texts([neutral, "those are scum", None, ""], *held)
    assert s[0] < 0.5 < s[1] and s[2] == s[3]


def test_quality_scores_equal_those_of_plain_loops():
    """Features one by one with whole numbers, their weights averaged; and the same from batches."""
    from quillion.llm import features

    mask, mul = (1 << 64) - 1, [int(m) for m in quality._MULTIPLIERS]

    def mix(h):
        for _ in range(2):
            h = ((h ^ (h >> 32)) * int(features._MIX)) & mask
        return h ^ (h >> 32)

    def word(w):
        return mix((sum((ord(c) + 1) * pow(features._P, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & mask)

    def plain(text):
        words = text.split()
        hs = [word(w) for w in words]
        got = hs + [mix(1 if a == b else (a * mul[1] + b) & mask) for a, b in zip(hs, hs[1:])]
        y = " " + re.sub(r"[\t-\r]", " ", text) + " "
        for n in quality.NGRAMS:
            for k in range(len(y) - n + 1):
                if " " not in y[k + 1 : k + n - 1]:
                    got.append(mix((n + sum(ord(c) * mul[j] for j, c in enumerate(y[k : k + n]))) & mask))
        return [h >> (64 - quality.BITS) for h in got]

    table = np.random.default_rng(1).normal(size=1 << quality.BITS)
    texts = ["one two two three\nfour", "é ß 𝔘x", "a", "the same the same the same"]
    want = [1 / (1 + np.exp(-(np.mean([table[b] for b in plain(t)]) + 0.25))) for t in texts]
    assert np.abs(quality.score_texts(texts, table, 0.25) - want).max() < 1e-9


def test_quality_steps_go_down_the_loss():
    """One step for one text moves every weight against the numeric gradient of its loss."""
    rng = np.random.default_rng(7)
    at, counts = np.array([3, 9, 20]), np.array([1.0, 2.0, 1.0])
    emb, layer = rng.normal(0, 0.1, (32, 4)), rng.normal(0, 0.1, (4, 2))
    start = emb @ (layer[:, 1] - layer[:, 0])

    def loss(e, w):
        z = (counts / counts.sum()) @ e[at] @ w
        return np.log(np.exp(z).sum()) - z[1]

    moved, bias = quality.train([(at, counts, 1)], {0: 1, 1: 1}, bits=5, dim=4, epochs=1, rate=1e-3)
    step = lambda g: -1e-3 * np.sign(g)  # noqa: E731  the first step of each weight has the size of the rate
    num = lambda a, f: np.array([[(f(a + d) - f(a - d)) / 2e-6 for j in range(a.shape[1]) for d in [np.eye(1, a.size, i * a.shape[1] + j).reshape(a.shape) * 1e-6]] for i in range(a.shape[0])])
    ge, gl = num(emb, lambda e: loss(e, layer)), num(layer, lambda w: loss(emb, w))
    new_layer = layer + step(gl)
    scale = np.where(np.abs(ge).sum(1, keepdims=True) > 0, ge / np.sqrt(np.maximum((ge**2).mean(1, keepdims=True), 1e-30)), 0)
    want = (emb - 1e-3 * scale) @ (new_layer[:, 1] - new_layer[:, 0])
    assert np.abs(moved - want).max() < 2e-4 and np.abs(moved - start).max() > 2e-4 and abs(bias - 2e-3) < 1e-5


def test_toxicity_training_ends_where_the_penalised_loss_is_least():
    kinds = toxicity.swaps(10)
    rng = np.random.default_rng(2)
    texts = [f"{a} {b} {c}" for a, b, c in zip(rng.choice(["scum", "nice", "day", "rain"], 120), rng.choice(["muslims", "women", "town", "old"], 120), (f"w{k}" for k in range(120)), strict=True)]
    y = np.array([int("scum" in t or ("muslims" in t and "rain" in t)) for t in texts])
    rows = toxicity.present(texts, 10)
    table, bias = toxicity.train(rows, y, bits=10, kinds=kinds)
    some = toxicity.distinct(rows, y)
    rows, y = [rows[i] for i in some], y[some]
    other = toxicity.counterfactuals(rows, kinds)
    used = toxicity.screen(rows, y, kinds, 10)
    share = [w / max(1, (y == c).sum()) for c, w in enumerate(toxicity.LABEL_WEIGHTS)]

    def loss(w, b):
        """Sums text by text: weighted log loss, ridge, and mean squared change under swaps."""
        z = [w[r].sum() + b for r in rows]
        fit = sum(share[t] * (np.log1p(np.exp(v)) - t * v) for v, t in zip(z, y, strict=True))
        swapped = sum((w[r].sum() - w[rows[i]].sum()) ** 2 for i, r in other) / max(1, len(other))
        return fit + toxicity.RIDGE * (w**2).sum() + toxicity.SWAP_WEIGHT * swapped

    assert other and len(used) < 1 << 10
    eps = 1e-5
    slope = [(loss(table + d, bias) - loss(table - d, bias)) / (2 * eps) for k in used for d in [np.eye(1, 1 << 10, k)[0] * eps]]
    assert np.abs(slope).max() < 5e-3 and abs((loss(table, bias + eps) - loss(table, bias - eps)) / (2 * eps)) < 5e-3


def test_rare_words_that_separate_take_part():
    """A word in 1 % of the toxic rows and in no other is let in by its certainty."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    toxic = [f"{word()} {word()} {'rareslur' if k % 80 == 0 else 'scum'}" for k in range(4000)]
    clean = [f"{word()} {word()} {word()}" for _ in range(4000)]
    rows, y = toxicity.present(toxic + clean), np.repeat([1, 0], 4000)
    (bucket,) = toxicity.present(["rareslur"])[0].tolist()
    assert bucket in toxicity.screen(rows, y, toxicity.swaps())


def test_dropout_equals_a_plain_simulation(model):
    """Merging by looking over the whole list each time, with draws from whole numbers, outside the class."""
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    score = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    mask, place_by, piece_by, rate = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0.3

    def mixed(h):
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & mask
        return h ^ (h >> 32)

    def skipped(key, at, piece):
        h = key ^ ((at * place_by + piece * piece_by) & mask)
        h = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & mask
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
        return (h ^ (h >> 32)) < int(rate * 2.0**64)

    def simulated(key, chunk):
        parts = [(i, c) for i, c in enumerate(chunk)]
        while True:
            able = [(-score[a + b][1], i, k) for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:])) if a + b in score and not skipped(key, i, score[a + b][0])]
            if not able:
                return [x for _, p in parts for x in ([score[p][0]] if p in score else [sp.piece_to_id(f"<0x{b:02X}>") for b in p.encode()])]
            _, i, k = min(able)
            parts[k : k + 2] = [(i, parts[k][1] + parts[k + 1][1])]

    p = pieces.Pieces(model, 11, rate, 4)
    for text in ("representation learning of unbelievable representation words", "naïve café-ÿ \U0001f600 internationalisation, 12345", "the " * 30):
        first = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, key=b"11/4").digest(), "little")
        want = [x for n, c in enumerate(p.split(text), 1) for x in simulated(mixed(mixed((first + n * place_by) & mask)), c)]
        assert p.encode([text])[0].tolist() == want


def test_toxicity_scores_equal_those_of_plain_loops():
    """Words by a plain loop, each once a text; terms and their pairs have buckets of their own."""
    texts = ["Those MUSLIMS, are nice. Women met men! old\ndeaf", "muslims muslims", "été naïve_word x2", "", None, "the women"]
    rng = np.random.default_rng(5)
    table = rng.normal(size=1 << 12)
    terms = [t for kind in toxicity.IDENTITY_TERMS for t in kind]
    one = lambda w: int(toxicity.present([w], 12)[0][0])
    hash_of = lambda w: toxicity.words([w])[1]

    def features(text):
        out = set()
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            w = re.findall(r"[^\W_]+", sentence)
            out |= {one(x) for x in w}
            out |= {int(toxicity.bucket(toxicity.pair(hash_of(a), hash_of(b)), 12)[0]) for a, b in zip(w, w[1:], strict=False) if a in terms or b in terms}
        return out

    want = [1 / (1 + np.exp(-(sum(table[f] for f in features(t)) - 0.5))) for t in texts]
    assert np.allclose(toxicity.score_texts(texts, table, -0.5), want)
    assert [sorted(features(t)) for t in texts] == [p.tolist() for p in toxicity.present(texts, 12)]
    assert sorted(one(t) for t in terms) == list(range(len(terms))) and all(one(w) >= len(terms) for w in ("scum", "nice", "x2"))


def test_swaps_stay_in_their_sentence():
    got = toxicity.sentence_swaps("The women left. Old men, old men stay. None here.")
    assert len(got) == 2 * 3  # women; old; men: each for another term and for a neutral word
    gone, come = got[0]
    assert len(gone) == 3 and len(come) == 3 and len(got[1][1]) == 0 and not set(gone) & set(come)
    assert toxicity.sentence_swaps(None) == [] == toxicity.sentence_swaps("no group in here")


def test_penalty_lowers_false_alarms_on_neutral_mentions():
    """Groups are named mostly in toxic texts; neutral texts that name them are rejected without the penalty, and kept with it."""
    rng = np.random.default_rng(9)
    filler = lambda n: " ".join(rng.choice([f"w{k}" for k in range(300)], n))
    groups = ["muslims", "christians", "jews", "women", "immigrants"]
    toxic = [f"{filler(8)}. those {rng.choice(groups)} are {rng.choice(['scum', 'vermin', 'filth'])}. {filler(4)}" for _ in range(250)] + [f"{filler(9)} {rng.choice(groups)} {filler(3)}" for _ in range(150)]
    clean = [f"{filler(10)}. {filler(5)}" for _ in range(390)] + [f"{filler(6)}. the {rng.choice(groups)} met at noon" for _ in range(10)]
    rows, y = toxicity.present(toxic + clean), np.repeat([1, 0], 400)
    changes = [toxicity.sentence_swaps(t) for t in toxic + clean]
    plain, held = (toxicity.train(rows, y, w, swapped=changes) for w in (0.0, toxicity.SWAP_WEIGHT))
    neutral = [f"{filler(9)}. the {g} of {filler(2)} sang" for g in groups for _ in range(20)]
    bad = [f"{filler(9)}. all {g} are {w}" for g in groups for w in ("scum", "vermin", "filth")]
    alarms = lambda m, t: int((toxicity.score_texts(t, *m) >= 0.5).sum())
    assert alarms(plain, neutral) >= 20 and alarms(held, neutral) <= 0.2 * alarms(plain, neutral) and alarms(held, bad) >= 0.9 * len(bad)
    assert alarms(held, [f"{filler(12)}" for _ in range(50)]) == 0
