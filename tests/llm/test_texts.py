import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tellurion.llm import chat, language, mixing, multiset, packing, toxicity
from tellurion.llm.common import text_key
from tellurion.llm.queries import tokenizer_path

from .conftest import prose

# ---- fingerprints


def ring(frame):
    """[(doc_id, text, next text)] by descending (doc_id, hash of the text), null ids last; the first follows the last."""
    k = text_key("text")
    rows = frame.select("doc_id", "text", k["a"].alias("a"), k["b"].alias("b")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.a or 0, r.b or 0), reverse=True)
    texts = [r.text or "" for r in rows]
    return [(r.doc_id, t, following) for r, t, following in zip(rows, texts, texts[1:] + texts[:1])]


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def told(doc_id, text, following):
    states = [multiset.State.of(t) for t in (text, edited(text, following), following)]
    return doc_id, len(text), hashlib.sha256(edited(text, following).encode()).hexdigest(), states[0].hex(), states[1].hex(), states[0].likeness(states[1]), states[0].likeness(states[2])


@pytest.mark.parametrize("buckets", [1, 4])
def test_fingerprints_of_edited_texts(odd, empty, buckets):
    """All rows, ties and repeated ones and null ids too."""
    got = multiset.fingerprint_documents(odd, buckets).collect()
    assert Counter(map(tuple, got)) == Counter(told(*r) for r in ring(odd))
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[3].fingerprint
    assert by_id[2].near_next == 1.0 and 0.9 < by_id[3].near_next < 1
    assert by_id[5].fingerprint == by_id[6].fingerprint
    assert multiset.fingerprint_documents(empty, buckets).collect() == []


def test_an_id_that_many_rows_share_is_split(spark):
    """A third of all rows has one id, another no id: they are dealt to buckets by their texts, and the ring goes on through them."""
    rows = [(5 if k % 3 == 0 else None if k % 3 == 1 else k, f"text {k}\n" * 3) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = multiset.fingerprint_documents(frame, 5).collect()
    assert Counter(map(tuple, got)) == Counter(told(*r) for r in ring(frame))
    dealt, n = multiset.neighbours(frame, 20)
    most = max(r["count"] for r in dealt.groupBy("bucket").count().collect())
    assert n >= 20 and most <= 3 * len(rows) / 20


M64 = (1 << 64) - 1


def slow_mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def slow_alike(text):
    """The likeness lanes, run by run and bit by bit, in whole numbers."""
    base, runs = int(multiset._BASE), []
    for line in text.encode().split(b"\n"):
        words = [slow_mix(sum(int(multiset._VALUES[c]) * pow(base, i, 1 << 64) for i, c in enumerate(w)) & M64) for w in line.split()]
        for i in range(max(1, len(words) - multiset.RUN + 1) if words else 0):
            part, h = words[i : i + multiset.RUN], 0 if len(words) >= multiset.RUN else len(words)
            for w in part:
                h = (h * base + w) & M64
            runs.append(h)
    lanes = [0] * multiset.ALIKE
    for h in runs:
        for s, stream in enumerate(multiset._STREAMS):
            for k, byte in enumerate(slow_mix((h + int(stream)) & M64).to_bytes(8, "little")):
                for bit in range(8):
                    lanes[64 * s + 8 * k + bit] += 1 if byte >> (7 - bit) & 1 else -1
    return lanes, len(runs)


def test_likeness_equals_a_slow_count():
    texts = ["", "one", "one two three four five", prose(4, 40), prose(4, 39) + " x", "a b\nc d e f g h\n\n i \t j\x0bk", "é 𝄞 ü\nß"]
    for x in texts:
        lanes, runs = slow_alike(x)
        assert multiset.State.of(x).alike.tolist() == lanes and len(multiset._runs(x.encode())) == runs
        for y in texts:
            other, norm = slow_alike(y)[0], 0.0
            norm = math.sqrt(sum(a * a for a in lanes) * sum(b * b for b in other))
            cosine = sum(a * b for a, b in zip(lanes, other)) / norm if norm else 0.0
            assert math.isclose(multiset.State.of(x).likeness(multiset.State.of(y)), 1.0 if x == y else min(1.0, max(0.0, cosine)), abs_tol=1e-12)


@pytest.mark.parametrize("buckets", [1, 3])
def test_the_last_document_is_followed_by_the_first(spark, buckets):
    rows = [(i, f"text {i} " * (i + 1)) for i in range(20)]
    got = {r.doc_id: r for r in multiset.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), buckets).collect()}
    for i, t in rows:
        following = rows[(i - 1) % 20][1]
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()


def test_states_add_and_subtract():
    a, b = prose(1, 100), prose(2, 100)
    both = multiset.State.of(f"{a}\n{b}")
    assert both == multiset.State.of(f"{b}\n{a}") == multiset.State.of(a) + multiset.State.of(b)
    assert both - multiset.State.of(b) == multiset.State.of(a)
    assert multiset.State.read(both.hex()) == both
    assert multiset.State.of(f"{a}\n{a}") != multiset.State.of(a)
    assert both.likeness(multiset.State.of(a)) > 0.5 > multiset.State.of(a).likeness(multiset.State.of(b))


def test_likeness_of_very_long_repetitive_texts(spark):
    """The sums of signs leave 16 bits."""
    prose = " ".join(f"w{k}" for k in range(1000))
    for n in (40_000, 65_536, 100_000):
        whole, half = multiset.State.of("word " * n), multiset.State.of("word " * (n // 2) + prose)
        assert whole.likeness(half) > 0.99
        assert (whole - half).alike.tolist() == (whole.alike - half.alike).tolist()
        assert multiset.State.read(whole.hex()).likeness(multiset.State.read(half.hex())) == whole.likeness(half)
    assert multiset.State.of("word " * 100_000).likeness(multiset.State.of("word " * 30_000)) > 0.99
    passage = " ".join(f"p{k}" for k in range(40)) + " "
    rows = [(1, prose), (2, "word " * 100_000), (3, prose), (4, passage * 5000), (5, prose), (6, "word " * 40_000)]
    got = {r.doc_id: r for r in multiset.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert all(got[k].near_edited > 0.9 for k in (2, 4, 6))


# ---- packing


def test_packing_is_an_exact_round_trip(odd, docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for frame in (odd, docs):
        given = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in frame.collect())
        pieces = packing.pack(frame, tokenizer_path(), with_ids=True).collect()
        sequences, ids = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
            sequences[p.sequence_id].append((p.offset, p.length))
            ids[p.doc_id].append(p)
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at == packing.CAPACITY or at & (at - 1) == 0
        for d, own in ids.items():
            if sum(k[0] == d for k in given.elements()) == 1:
                assert given[d, tuple(x for p in sorted(own, key=lambda p: p.start) for x in p.ids)] == 1
        assert sum(p.length for p in pieces) == sum(len(k) * n for (_, k), n in given.items())
    assert packing.pack(empty, tokenizer_path()).collect() == []


def test_words_encode_as_whole_texts():
    t = Tokenizer.from_file(tokenizer_path())
    texts = ["", "a, b. C,", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|> Z", "é \u0301x", "\u2028a\x1cb \x85 c", "\x1c\x1d z", "ΑΣ ΣΑ", "don't I'LL x., y", "İstanbul ﬁ", prose(5, 500)]
    words = packing.Words(tokenizer_path())
    for _ in range(2):
        for x in texts:
            assert words.encode(x).tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]
    words = packing.Words(tokenizer_path(), 20)
    for x in texts:
        assert words.encode(x).tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


def test_harmonic_bins_hold_a_fixed_count():
    """A closed bin is full: as many whole rests of its class as the class says, and the head of another."""
    rng = np.random.default_rng(3)
    for sizes in ([30] * 40, rng.integers(1, 200, 300), [64, 32, 32, 128, 21, 21, 21, 22]):
        bins = packing.Bins(64)
        for d, n in enumerate(sizes):
            bins.add(d, np.arange(n, dtype=np.uint32))
        closed = defaultdict(list)
        for _, start, ids, _, sequence, offset in bins.rows:
            closed[sequence].append((offset, len(ids)))
        assert closed
        for own in closed.values():
            lengths = [n for _, n in sorted(own)]
            assert sum(lengths) == 64
            k = min(64 // lengths[0], packing.LAST)
            assert all(64 // n == k for n in lengths[:-1])
            assert len(lengths) == k + 1 or (len(lengths) == k and 64 // lengths[-1] == k) or lengths == [64]
        bins.finish()
        assert sum(len(ids) for _, _, ids, *_ in bins.rows) == sum(sizes)
        pieces = sorted((d, start, len(ids)) for d, start, ids, *_ in bins.rows)
        assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_tokenizer_gets_its_own_ids(spark, name):
    """One that keeps case and white space is given whole texts."""
    path = public_tokenizers.path(name)
    t, words = Tokenizer.from_file(path), packing.Words(path, end=9)
    assert words.apart == (name == "word_bpe_49k.json")
    for x in (*packing.TEXTS, "Hello World. Foo", "a b  c", prose(7, 300), "MIXED Case, é. \n\n x", "<|endoftext|> y"):
        assert words.encode(x).tolist() == [*t.encode(x, add_special_tokens=False).ids, 9]
    frame = spark.createDataFrame([(1, "Hello World. Foo\n a  b"), (2, None)], "doc_id long, text string")
    got = defaultdict(list)
    for r in sorted(packing.pack(frame, path, with_ids=True, end=9).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += r.ids
    assert got == {1: [*t.encode("Hello World. Foo\n a  b", add_special_tokens=False).ids, 9], 2: [9]}


# ---- mixing


def water(sizes):
    """Targets by pouring the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    rest, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        free -= set(over)
    return target


def slow_rates(sizes, target):
    """{size: rate} of one source's documents: the tilt is found by halving."""
    total, scale = sum(sizes), sum(n * n for n in sizes) / max(1, sum(sizes))
    if target >= mixing.MOST * total:
        return dict.fromkeys(sizes, float(mixing.MOST))
    rates = lambda tilt: {n: mixing.MOST / (1 + (mixing.MOST - 1) * math.exp(min(700.0, -tilt * n / scale))) for n in sizes}
    low, high = -1e4, 1e4
    for _ in range(200):
        tilt = (low + high) / 2
        r = rates(tilt)
        low, high = (tilt, high) if sum(n * r[n] for n in sizes) < target else (low, tilt)
    return rates((low + high) / 2)


def mixture(spark):
    """Many short documents of four sources, of which one is hot and one null."""
    rng = np.random.default_rng(12)
    rows = [(k, "w " * int(rng.integers(1, 60)), ["a", "b", None, "c"][int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]) for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("table", ["docs", "odd", "many"])
def test_mixing_meets_targets(table, spark, request):
    frame = mixture(spark) if table == "many" else request.getfixturevalue(table)
    got = mixing.mix_report(frame).collect()
    sizes = defaultdict(list)
    for r in frame.collect():
        sizes[r.source].append(len((r.text or "").encode().split()))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, len((r.text or "").encode().split())) for r in frame.collect())
    expected = water({s: sum(n) for s, n in sizes.items()})
    for s, own in sizes.items():
        rows = [r for r in got if r.source == s]
        assert all(r.source_size == sum(own) and math.isclose(r.target, expected[s], rel_tol=1e-9, abs_tol=1e-6) for r in rows)
        rates = slow_rates(own, expected[s])
        for r in rows:
            assert math.isclose(r.rate, rates[r["size"]], rel_tol=1e-5, abs_tol=1e-7)
            if r["size"]:
                assert r.taken % r["size"] == 0 and math.floor(r.rate) <= r.taken // r["size"] <= min(mixing.MOST, math.floor(r.rate) + 1)
        taken, largest = sum(r.taken for r in rows), max(own)
        assert abs(taken - expected[s]) <= (0.01 * expected[s] if table == "many" else largest / 2 + 1e-6 if table == "docs" else 2 * largest)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(frame).collect()), key=str)


def test_mixing_takes_empty_tables_huge_texts_and_says_where_it_fails(spark, empty, monkeypatch):
    assert mixing.mix_report(empty).collect() == []
    huge = spark.createDataFrame([("a", 3 * 10**9, 4), ("a", 10, 4)], "source string, size long, n long")
    state = spark.createDataFrame([("a", 12 * 10**9 + 40, 1.5e10), ("b", 0, 0.0)], "source string, source_size long, target double")
    got = {r.source: r for r in mixing.solve(huge, state, True).collect()}
    assert got["b"].tilt == 0.0 and math.isclose(4 * 3e9 * 2 / (1 + math.exp(-got["a"].tilt * 3e9 / got["a"].scale)), 1.5e10, rel_tol=1e-6)
    monkeypatch.setattr(mixing, "STEPS", 1)
    monkeypatch.setattr(mixing, "TOGETHER", 1)
    with pytest.raises(RuntimeError, match="off its target"):
        mixing.solve(huge, state, True)


def test_mix_repeats_rows_as_reported(docs):
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix_report(docs).collect() if r["size"]}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in taken.items() if n})


# ---- chat


def test_chat_reads_back_what_was_said(spark):
    rows = [
        (1, 0, "user", "a\\b <| x |> </s>[INST] ok [/INST] \\"), (1, 1, "assistant", None), (1, 1, "assi\nst\\", "t"), (2, 0, None, ""), (2, 5, "assistant", "<|turn|>user\nhi<|end|>\n"),
        (2, 7, "assistant", "<<SYS>>$1\\$<</SYS>><s>\\\n"), (None, None, "assistant", "\\n"), (3, 0, "assistant", "é𝄞\u0001 \\<|"), (3, 0, "assistant", "é𝄞\u0001 \\<|"), (4, 1, "assistant", "x" * 200_000),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, message int, seq int")
    got = {r.conv_id: r for r in chat.report(frame).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.report(frame.limit(0)).collect() == []


def test_events_fold_into_messages(spark):
    rows = [
        (1, 1, 1, "message", "user", "helo"), (1, 1, 2, "edit", None, "hello"), (1, 2, 3, "message", "assistant", ""), (1, 2, 4, "delta", None, "a "), (1, 2, 5, "delta", None, "b"),
        (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "c "), (1, 2, 8, "delta", None, "d"), (2, 1, 1, "message", None, None), (2, 1, 1, "delta", None, "x"),
    ]
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.messages(spark.createDataFrame(rows[::-1], "conv_id long, message long, seq long, kind string, role string, text string")).collect()}
    assert got[1, 1] == ("user", "hello")
    assert got[1, 2] == ("assistant", "c d")
    assert got[2, 1][0] == ""


# ---- classifiers


def test_language_is_learned_from_the_allowed_rows(docs, odd, empty):
    got = {r.doc_id: r for r in language.report(docs).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.collect() if got[r.doc_id].held_out and r.lang]
    assert len(right) > 20 and sum(right) / len(right) > 0.85
    for r in docs.collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    out = language.report(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (5, 6, 7, 11)} == {"und"}
    assert language.report(empty).collect() == []
    assert {r.doc_id for r in language.keep_known(odd).collect()}.isdisjoint({5, 6, 7, 11})
    assert language.keep_known(empty).collect() == []


def test_an_id_of_many_rows_counts_once(spark):
    """A language most of whose rows share one id is still learned from the others, of each of which one row is taken."""
    rows = [(7, "the rain in " + prose(k, 30), "en") for k in range(3000)]
    rows += [(100 + k, "the rain and the " + prose(k, 30), "en") for k in range(900)] + [(5000 + k, "ße üb öl " + prose(k, 30).upper(), "de") for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = Counter()
    for r in language.sample(frame, 4, 2).collect():
        counts[r.lang] += 1
        assert r.doc_id == 7 or r.text in {t for d, t, _ in rows if d == r.doc_id}
    allowed = Counter(lang for d, lang in {(d, lang) for d, _, lang in rows} if zlib.crc32(str(d).encode()) % 4 != 2)
    assert counts == {lang: min(n, language.SAMPLE) for lang, n in allowed.items()}
    assert language.train(frame).languages == ["de", "en"]


def test_more_languages_than_are_learned(spark, monkeypatch):
    """Those of most documents are, each from fewer documents."""
    monkeypatch.setattr(language, "LANGUAGES", 2)
    monkeypatch.setattr(language, "ROOM", 10 * language.PIECES)
    rows = [(100 * n + k, f"word {n} {k}", lang) for n, lang in enumerate(("a", "b", "c", "d")) for k in range(20 * (n + 1))]
    got = Counter(r.lang for r in language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4, 2).collect())
    assert got == {"c": 5, "d": 5}


def small_network():
    rng = np.random.default_rng(8)
    n, wide = 5, max(language.WIDTHS)
    shapes = {"vectors": (256, 3), "filters": (wide * 3, n), "bias": (n,), "out": (n, 3), "offset": (3,)}
    return language.Network(["a", "b", "c"], *(rng.normal(size=shapes[k]) for k in language.WEIGHTS))


def slow_forward(net, window):
    """Scores of one window, place by place and filter by filter."""
    wide, size = max(language.WIDTHS), net.vectors.shape[1]
    raw = window.ljust(language.WINDOW, b"\0")
    h = []
    for f in range(net.filters.shape[1]):
        best = max(sum(net.vectors[raw[at + k]][v] * net.filters[k * size + v][f] for k in range(wide) for v in range(size)) for at in range(language.WINDOW - wide + 1))
        h.append(max(0.0, best + net.bias[f]))
    z = [sum(h[f] * net.out[f][k] for f in range(len(h))) + net.offset[k] for k in range(len(net.languages))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_the_network_equals_a_slow_forward_pass():
    net, texts = small_network(), [prose(1, 60), "kürz", "x", "", None, "12 !", prose(2, 4)]
    windows = [w for t in texts if t for w in language.cut_up(t)]
    assert np.allclose(net.probabilities(language.as_array(windows)), [slow_forward(net, w) for w in windows])
    name, score = net.judge(texts)
    for t, n, s in zip(texts, name, score):
        if not t or not any(c.isalpha() for c in t):
            assert (n, s) == ("und", 0.0)
            continue
        raw = t.lower().encode()
        parts = [raw[i : i + language.WINDOW] for i in range(0, len(raw), language.WINDOW)]
        assert b"".join(parts) == raw  # whole texts
        p = sum(np.array(slow_forward(net, w)) * len(w) for w in parts) / len(raw)
        assert n == net.languages[int(p.argmax())] and math.isclose(s, p.max())


def test_gradients_equal_differences():
    net, rng = small_network(), np.random.default_rng(9)
    windows = language.as_array([prose(k, 12).encode() for k in range(6)])
    labels = np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.gradients(windows, labels)
    seen = np.unique(windows)
    for k in language.WEIGHTS:
        w = getattr(net, k)
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in w.shape)
            if k == "vectors":
                at = (int(rng.choice(seen)), at[1])
            was, step = w[at], 1e-6
            w[at] = was + step
            high = net.gradients(windows, labels)[0]
            w[at] = was - step
            low = net.gradients(windows, labels)[0]
            w[at] = was
            assert math.isclose(grads[k][at], (high - low) / (2 * step), rel_tol=1e-3, abs_tol=1e-6), (k, at)


def toxic_docs(spark):
    rows, labels = [], []
    for i in range(240):
        words = prose(i + 50, 120 if i % 3 else 15).split()
        toxic = i % 4 == 0
        if toxic:
            for k in range(3):
                words.insert((i * 7 + 13 * k) % len(words), ("vile", "nastige", "nastung", "nastheit")[(i + k) % 4])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found(spark, odd, empty):
    docs, labels = toxic_docs(spark)
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d in truth if got[d].held_out} == set(held)
    assert sum(got[d].predicted == truth[d] for d in held) >= len(held) - 1
    assert all(got[d].passages for d in truth if truth[d] and got[d].predicted)
    extra = toxicity.report(odd, labels).collect()
    assert len(extra) == odd.count() and all(0 <= r.score <= 1 for r in extra)
    assert toxicity.report(empty, labels).collect() == []
    assert all(r.predicted == 0 for r in toxicity.report(odd, labels.limit(0)).collect())
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_toxicity_holds_on_documents_that_it_has_not_seen(spark):
    """Held-out labelled rows of the supplied table: most are right, and of the clean ones about as many have a significant passage as is said."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = [r for r in toxicity.report(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").repartition(4), labels).where("held_out").collect() if r.doc_id in truth]
    toxic, clean = ([r for r in got if truth[r.doc_id] == k] for k in (1, 0))
    assert len(toxic) > 50 and len(clean) > 500
    assert sum(r.predicted for r in toxic) > 0.9 * len(toxic) and sum(r.predicted for r in clean) < 0.02 * len(clean)
    assert sum(len(r.passages) > 0 for r in clean) < 3 * toxicity.SIGNIFICANT * len(clean)
    assert all(p.expected <= toxicity.SIGNIFICANT and p.start < p.end for r in got for p in r.passages)


def test_the_lexicon_equals_a_slow_count(spark):
    docs, labels = toxic_docs(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    n, counts = Counter(), {}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            n[truth[r.doc_id]] += 1
            for f in {f for w in r.text.lower().split() for f in toxicity.features(w)}:
                counts.setdefault(f, Counter())[truth[r.doc_id]] += 1
    expected = {}
    for f, c in counts.items():
        prior = toxicity.PRIOR * (c[0] + c[1]) / (n[0] + n[1])
        odds = math.log((c[1] + prior) / max(0.5, n[1] + toxicity.PRIOR - c[1] - prior)) - math.log((c[0] + prior) / max(0.5, n[0] + toxicity.PRIOR - c[0] - prior))
        if odds > toxicity.LEAST and odds / math.sqrt(1 / (c[1] + prior) + 1 / (c[0] + prior)) > toxicity.OUTSTANDING:
            expected[f] = min(odds, toxicity.LARGEST)
    got = toxicity.train(docs, labels).lexicon
    assert expected and got.keys() == expected.keys()
    assert all(math.isclose(got[f], x, rel_tol=1e-9) for f, x in expected.items())


@pytest.mark.parametrize(("decay", "scale"), [(1.0, 0.01), (1.6, 0.1), (0.6, 0.5)])
def test_extreme_values_are_fitted(decay, scale):
    """To best passages drawn from the law itself; no point of a grid is likelier."""
    rng = np.random.default_rng(2)
    n = rng.integers(5, 2000, 4000)
    best = (np.log(scale * n) - np.log(-np.log(rng.random(len(n))))) / decay
    best = np.where(best < 0.8, 0.0, best)  # no passage
    got = toxicity.extremes(n, best)
    assert math.isclose(got[0], decay, rel_tol=0.1) and math.isclose(got[1], scale, rel_tol=0.3)

    def likelihood(decay, scale):
        hit, least = best > 0, best[best > 0].min()
        found = np.where(hit, best, least)
        return (np.log(decay * scale * n[hit]) - decay * best[hit]).sum() - (scale * n * np.exp(-decay * found)).sum() + 5 * (np.log(decay) - decay)

    assert likelihood(*got) >= max(likelihood(got[0] * a, got[1] * b) for a in np.linspace(0.7, 1.4, 15) for b in np.linspace(0.5, 2, 16)) - 1e-2
    assert all(np.isfinite(toxicity.extremes(np.array(n), np.array(s))).all() for n, s in (([], []), ([0], [0.0]), ([5, 9], [0.0, 0.0]), ([4], [2.0])))


def brute_segments(scores):
    """All maximal scoring subsequences by their recursive definition."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return [*brute_segments(scores[:i]), (i, j, best), *[(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]]


def test_segments_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        hot = rng.random(n) < 0.3
        scores = np.where(hot, rng.integers(1, 5, n) + rng.random(n) / 7, -0.83)
        got = toxicity.segments(np.flatnonzero(hot).tolist(), scores[hot].tolist(), -0.83)
        expected = brute_segments(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in got], [s for *_, s in expected])
