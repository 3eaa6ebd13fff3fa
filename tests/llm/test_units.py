"""Parts of the operators against brute force, without a session."""

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringspark.llm import embeddings, language, lines, media, neardup, packing, toxicity


def jaccard_set(text):
    words = toxicity_words(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def toxicity_words(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbBé \t\n\x0b\x1f\xa0", max_size=60))
def test_shingles_count(text):
    assert len(neardup.shingles(text)) == len(jaccard_set(text))


def test_words_hash_by_content():
    a = neardup.word_hashes("Ab  cd\tab É é".encode())
    assert a[0] == a[2] and a[0] != a[1] and a[3] != a[4]
    assert neardup.word_hashes(b"xx ab")[1] == a[0]


def test_sketch_never_rules_out_what_is_similar():
    rng = np.random.default_rng(1)
    for n in (20, 150, 600, 5000):
        for _ in range(30):
            base = rng.integers(0, 1 << 64, n, np.uint64)
            other = base.copy()
            k = int(n * 0.08)  # similarity about 0.852
            other[:k] = rng.integers(0, 1 << 64, k, np.uint64)
            a, b = np.unique(base), np.unique(other)
            x, y = neardup.sketch(a)[None, :], neardup.sketch(b)[None, :]
            assert neardup.may_link(x, y, np.array([len(a)]), np.array([len(b)]), 0.85)[0]


text = st.text(max_size=80) | st.text(alphabet="ab c'ré1 \n.,!?s", max_size=80)


@settings(max_examples=300, deadline=None)
@given(text)
def test_tokens_are_the_tokenizers_own(value):
    got = next(packing.encode([value]))
    want = packing._exact(None).encode(value, add_special_tokens=False).ids
    assert got.tolist() == want


@given(st.integers(1, 9000))
def test_cut(n):
    parts = packing.cut(n, 2048)
    assert [a for a, _ in parts] == list(itertools.accumulate([0] + [b for _, b in parts]))[:-1] and sum(b for _, b in parts) == n
    assert all(b == 2048 for _, b in parts[1:]) and 1 <= parts[0][1] <= 2048


def fewest(sizes, c):
    best = len(sizes)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= c:
                put(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bounds_and_packers(sizes):
    order = np.array(sorted(sizes, reverse=True))
    low, best = packing.bound(np.bincount(order, minlength=21)), fewest(order.tolist(), 20)
    assert low <= best
    for f in (packing.best_fit, packing.complete_fit):
        bins, places, room = f(order, 20)
        assert len(room) >= best
        for b in range(len(room)):
            own = sorted((p, s) for p, s, k in zip(places.tolist(), order.tolist(), bins.tolist(), strict=True) if k == b)
            assert [p for p, _ in own] == list(itertools.accumulate([0] + [s for _, s in own]))[:-1] and sum(s for _, s in own) + room[b] == 20


@given(st.lists(st.text(alphabet="ab", max_size=2), min_size=0, max_size=200))
def test_chunks_cover_the_lines(rows):
    found = lines.chunks(rows)
    if len(rows) < 2:
        assert found == []
    else:
        assert [a for a, _ in found] == list(itertools.accumulate([0] + [n for _, n in found]))[:-1] and sum(n for _, n in found) == len(rows)
        assert all(2 <= n <= 65 for _, n in found)


def test_boundaries_resist_shifts():
    rows = [f"line {k * 7919 % 1013}" for k in range(400)]
    whole = {tuple(rows[a : a + n]) for a, n in lines.chunks(rows)}
    shifted = {tuple(r) for r in ([["new", *rows][a : a + n] for a, n in lines.chunks(["new", *rows])])}
    assert len(whole & shifted) > 0.9 * len(whole)


@settings(deadline=None)
@given(st.text(max_size=2000))
def test_media_round_trip(value):
    data = media.payload(value)
    assert len(data) % 576 == 0 and len(data) >= 576 and data.startswith(value.encode("utf-8", "surrogatepass"))
    assert media.decode(media.encode(data)) == data
    pairs = media.fingerprint(data)
    assert (np.diff(pairs) >= 0).all() and (media.fingerprint(data) == pairs).all()


def test_media_finds_a_tone():
    t = np.arange(576 * 20)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / 576) * (1 + (t // 2000 % 2))).astype(np.uint8)
    found = media.peaks(tone)
    assert set(found[:, 1][found[:, 1] > 0]) == {40}


def test_folding():
    assert toxicity.fold_text("1D10T, ｉdіоt!!") == toxicity.fold_text("idiot idiot")
    assert toxicity.fold_text(None) == toxicity.fold_text(" \t") == ""


def test_exception_phrases_spare():
    lexicon = toxicity.Lexicon({" bad": 2.0}, (toxicity.fold_text("bad weather"),))
    auto = lexicon.automaton()
    assert len(toxicity.matches(auto, toxicity.fold_text("such bad weather, bad man, badly"))) == 2


@pytest.mark.parametrize("blank", [" ", "\n", " \n", "\r\n", "\t"])
@pytest.mark.parametrize("n", [24_000, 49_000, 1_000_000])
def test_tokens_of_blanks(blank, n):
    value = "a " + blank * (n // len(blank)) + " b"
    assert next(packing.encode([value])).tolist() == packing._exact(None).encode(value, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 50_000])
def test_exceptions_of_a_long_text(n):
    lexicon = toxicity.Lexicon({" bad": 2.0, " sad": 1.0}, tuple(map(toxicity.fold_text, ("bad weather", "so bad weather", "sad"))))
    found = toxicity.matches(lexicon.automaton(), toxicity.fold_text("so bad weather sad sadly bad " * n))
    assert len(found) == 2 * n and sum(found.values()) == 3.0 * n


def test_language_blocks_agree(monkeypatch):
    value = "Größe und 12 Maße, niño! " * 50
    whole = np.bincount(language.slots(value), minlength=language.SLOTS)
    monkeypatch.setattr(language, "BLOCK", 37)
    assert (language.tally(value) == whole).all()


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("spread", [0.02, 0.15, 0.6])
def test_traversal_is_exact(same, spread):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 12))
    make = lambda n: embeddings.unit(base[rng.integers(0, 20, n)] + spread * rng.normal(size=(n, 12)))
    a = make(400)
    b = a if same else make(300)
    ta = embeddings.Tree(a, embeddings.nodes(a))
    tb = ta if same else embeddings.Tree(b, embeddings.nodes(b))
    wa, wb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
    if same:
        wb = wa
    la, lb, root = embeddings.traverse(ta, tb, wa, wb, 0.95, same)
    hit = ta.v @ tb.v.T >= 0.95
    if same:
        np.fill_diagonal(hit, False)
    assert (la == hit @ wb).all()
    if not same:
        assert (lb == wa @ hit).all()
    n = len(a) if same else len(a) + len(b)
    want = list(range(n))
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = want[i], want[j + (0 if same else len(a))]
        want = [min(x, y) if w in (x, y) else w for w in want]
    assert root.tolist() == want


def test_crc_of_ids():
    ids = np.append(next(packing.encode(["hello there"])), 0).astype("<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
