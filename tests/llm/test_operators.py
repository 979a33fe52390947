"""Each training-data operator against brute force, and its defined results for odd input."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import (census, decontamination, html_text, language, ngram_join, packing, quality, sharding, shared, substrings,
                          token_counts)
from tidemark.llm.bytebpe import ByteBpe
from tidemark.llm.queries import BYTE_BPE, PIECE_BPE
from tidemark.llm.token_files import Reader, read_token_files, write_token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, h string, label int, chunk int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["a"] * len(texts))[k], 1, "x", 5, None, 3, 9)
            for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def sentences(seed, n, size=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(5, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_texts():
    base = sentences(1, 30)
    long = " ".join(sentences(2, 300))
    return [*base, None, "", " ", "\n\n", "one", base[0], base[0], base[1] + " tail", long, long, "é ß 中文 \x00 a", "a  b\n c ",
            "x <|endoftext|> </s> ▁y", "a" * 3000, base[2].upper()]


def tokens_of(text):
    ids = Tokenizer.from_file(BYTE_BPE).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 0], "<u4")


def test_encoder_equals_the_library(odd_texts):
    texts = [t or "" for t in odd_texts] + ["foo's it's  \n x 12 34a,b", "a\x1c b", "　 a", "w, w, w. W."]
    model = ByteBpe(BYTE_BPE)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, model.encode(texts)):
            assert np.frombuffer(ids, model.dtype).tolist() == tokens_of(text)[:-1].tolist()


def test_token_files(spark, odd_texts, tmp_path):
    docs = frame(spark, odd_texts, ids=[3 * k for k in range(len(odd_texts))]).repartition(5)
    manifest = write_token_files(docs, BYTE_BPE, target=f"file://{tmp_path}/out")
    rows = {r["doc_id"]: r for r in read_token_files(manifest).collect()}
    start = 0
    for k, text in enumerate(odd_texts):
        ids, row = tokens_of(text), rows[3 * k]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = Reader(manifest.collect()[0]["path"])
    asked = one.ids[len(one.ids) // 2]
    assert one.read([asked])[asked][0].tolist() == tokens_of(odd_texts[asked // 3]).tolist()


def test_damaged_frame_is_found(spark, tmp_path):
    manifest = write_token_files(frame(spark, ["some words here"]), BYTE_BPE, target=str(tmp_path / "out"))
    path = manifest.collect()[0]["path"]
    raw = bytearray(open(path, "rb").read())
    raw[12] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        Reader(path).frame(0)


def test_repeated_ids_are_all_written(spark, tmp_path):
    manifest = write_token_files(frame(spark, ["a b", "a b", None], ids=[7, 7, None]), BYTE_BPE, target=f"file://{tmp_path}/out")
    rows = read_token_files(manifest).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in rows) == [(False, 3), (False, 3), (True, 1)]


def test_language_rows_and_accuracy(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "th", "wh", "ea"], "de": ["sch", "ung", "ei", "ü", "cht"], "fr": ["eau", "oi", "é", "que", "ou"]}
    langs = [rng.choice(sorted(parts)) for _ in range(240)]
    texts = [" ".join("".join(rng.choices(parts[g], k=3)) for _ in range(40)) for g in langs]
    texts += [None, "", "123 !!", "th" * 20000]
    docs = frame(spark, texts, langs=langs + [None, "en", "en", None])
    rows = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs)).collect()}
    held = {r["doc_id"]: r["held_out"] for r in docs.select("doc_id", language.held_out().alias("held_out")).collect()}
    assert all(held[k] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in held)
    assert np.mean([rows[k]["lang_pred"] == g for k, g in enumerate(langs) if held[k]]) > 0.95
    assert [rows[k]["lang_pred"] for k in (240, 241, 242)] == ["und"] * 3 and rows[243]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_network_tables_equal_the_convolution():
    """The folded tables against the filters slid over embedded bytes, and the learned network on its own texts."""
    rng = np.random.default_rng(4)
    embed, filters, bias = rng.normal(size=(256, 3)), rng.normal(size=(language.SPAN, 3, 5)), rng.normal(size=5)
    data = rng.integers(0, 256, (4, language.WINDOW), dtype=np.uint8)
    net = language.Network(["x"], *language.folded(embed, filters), bias, np.zeros((5, 1)), np.zeros(1))
    for window, pooled in zip(data, net.pooled(data)):
        at = range(language.WINDOW - language.SPAN + 1)
        slid = [[sum(embed[window[i + k]] @ filters[k, :, f] for k in range(language.SPAN)) for i in at] for f in range(5)]
        assert np.allclose(pooled, np.maximum(np.max(slid, axis=1) + bias, 0), atol=1e-4)
    net = language.train(["aaaa bbbb " * 30, "cccc dddd " * 30], ["x", "y"], steps=40)
    odds = [net.probabilities(w) for w, _, _ in language.cut(*language.text_bytes(pa.array(["aaaa bbbb " * 30, "dddd cccc " * 30])))]
    odds = np.concatenate(odds)
    assert odds[0].argmax() == 0 and odds[-1].argmax() == 1 and np.allclose(odds.sum(axis=1), 1)


def test_windows_are_cut_in_steps():
    texts = ["", "a" * 5, "b" * language.WINDOW, "", "c" * (3 * language.WINDOW + 1), "é" * 200, ""]
    data, offsets = language.text_bytes(pa.array(texts))
    expected = []
    for k, t in enumerate(texts):
        raw = t.encode()
        for i in range(0, len(raw), language.WINDOW):
            part = raw[i:i + language.WINDOW]
            expected.append((part.ljust(language.WINDOW, b"\0"), k, len(part)))
    for most in (1, 2, 3, 100):
        steps = list(language.cut(data, offsets, most))
        assert all(len(w) <= most for w, _, _ in steps)
        assert [(w.tobytes(), r, n) for part in steps for w, r, n in zip(*part)] == expected


def test_training_windows_are_bounded_and_drawn_from_whole_texts(spark):
    long = "".join(chr(97 + k // 4000) * 10 for k in range(80_000))  # letters change along the text
    texts = [long, *sentences(21, 3000, 12), *["same text"] * 200, None, "", "x"]
    langs = ["xx"] + ["en"] * 3000 + ["de"] * 200 + ["en", "fr", None]
    docs = frame(spark, texts, ids=[0, *range(1, 3001), *[None] * 100, *[7] * 100, 8, 8, 8], langs=langs).repartition(5)
    found = language.training_windows(docs, per_language=50, windows=30)
    assert set(found) == {"xx", "en", "de"}  # 0, 7 and 8 are not held out
    assert len(found["de"]) == 1 and len(found["en"]) == 50 and 20 < len(found["xx"]) <= 30
    assert len({w[0] for w in found["xx"]}) > 10
    again = language.training_windows(docs.repartition(3), per_language=50, windows=30)
    assert all((found[k] == again[k]).all() for k in found)


def test_language_of_a_long_text_in_bounded_memory():
    net = language.train(["aaaa bbbb " * 30, "cccc dddd " * 30], ["x", "y"], steps=40)
    part = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["aaaa bbbb " * 400_000, "cccc dddd "]), pa.array([True, True])],
                                      names=["key", "text", "known"])
    tracemalloc.start()
    rows = language._labelled(net, part, False).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["lang_pred"] for r in rows] == ["x", "y"] and most < 60 << 20


def windows(text, n):
    w = WORD.findall(text or "")
    return w, [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def test_quality_counts_and_verdict(spark, odd_texts):
    texts = [*odd_texts, *(["spam spam eggs " * 40] * 2), "good line here\n" * 3, "# $ % " * 60]
    rows = {r["doc_id"]: r for r in quality.quality(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        w, wins = windows(text, 8)
        seen = defaultdict(list)
        for i, win in enumerate(wins):
            seen[win].append(i)
        covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"]) and r["kept"] is not None


def test_votes_are_weighed_together(spark):
    """Two rules that agree with the truth outvote one that does not."""
    rng = random.Random(5)
    rows = []
    for k in range(600):
        good = rng.random() < 0.7
        right = lambda p: (1 if good else -1) * (1 if rng.random() < p else -1)
        rows.append((k, good, right(0.95), right(0.9), right(0.55), 0 if rng.random() < 0.5 else right(0.9)))
    voted = spark.createDataFrame(rows, "k int, good boolean, a int, b int, c int, d int")
    p, fitted = quality.posterior(voted, ["a", "b", "c", "d"])
    found = voted.select("good", (p >= 0.5).alias("kept")).collect()
    assert np.mean([r["good"] == r["kept"] for r in found]) > 0.93
    assert fitted["rates"]["a"][1][0] > 0.85 and abs(fitted["share"] - 0.7) < 0.1


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 50)])
def test_join_links_as_brute_force(spark, odd_texts, size, percent):
    rng = random.Random(size)
    texts = list(odd_texts)
    for t in odd_texts[:12] * 3:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    rows = ngram_join.linked_groups(frame(spark, texts).repartition(3), size, percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
        assert r["first"] == (r["component_id"] == r["doc_id"])


@pytest.mark.parametrize("size", [1, 2, 13, 29])
def test_substrings_as_brute_force(spark, odd_texts, size):
    rng = random.Random(9)
    texts = list(odd_texts)
    passage = " ".join((texts[8] + " " + texts[10]).split()[:max(20, size + 3)])
    texts += [f"{a} \n {passage}\t{b}" for a, b in zip(texts[3:9], texts[9:15])]
    rng.shuffle(texts)
    first = {}
    for k, t in enumerate(texts):
        for win in windows(t, size)[1]:
            first.setdefault(win, k)
    rows = {r["doc_id"]: r for r in substrings.remove_repeated(frame(spark, texts).repartition(4), size).collect()}
    for k, t in enumerate(texts):
        w, wins = windows(t, size)
        gone = {p for i, win in enumerate(wins) if first[win] < k for p in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (rows[k]["n_words"], rows[k]["n_removed"], rows[k]["kept"]) == (len(w), len(gone), kept)


def test_levels_double_from_short_windows():
    assert substrings.levels(50) == [7, 13, 25, 50] and substrings.levels(13) == [7, 13]
    assert substrings.levels(7) == [4, 7] and substrings.levels(2) == [1, 2] and substrings.levels(1) == [1]
    for n in range(1, 300):
        made = substrings.levels(n)
        assert made[-1] == n and all(a < b <= 2 * a for a, b in zip(made, made[1:]))


@pytest.mark.parametrize("passage, passes", [(0, 0), (5, 0), (9, 1), (20, 2), (60, 3)])
def test_doubling_ends_where_nothing_repeats(spark, monkeypatch, passage, passes):
    """Levels 7, 13, 25, 50: a passage of nine words is given up after the second one, and so on."""
    done = []
    extended = substrings._extended
    monkeypatch.setattr(substrings, "_extended", lambda *a: done.append(a[3]) or extended(*a))
    shared_words = [f"s{k}" for k in range(passage)]
    texts = [" ".join([*(f"{name}{k}" for k in range(80)), *shared_words, f"{name}end"]) for name in "abc"]
    rows = substrings.remove_repeated(frame(spark, texts), 50).collect()
    assert done == [13, 25, 50][:passes]
    assert {r["doc_id"]: r["n_removed"] for r in rows} == ({0: 0, 1: 60, 2: 60} if passage == 60 else {0: 0, 1: 0, 2: 0})


def test_equal_and_missing_keys_take_nothing(spark):
    text = " ".join(sentences(4, 3))
    rows = substrings.remove_repeated(frame(spark, [text] * 4, ids=[1, 1, None, 2]), 5).collect()
    lost = {r["doc_id"]: r["n_removed"] for r in rows}
    assert len(rows) == 4 and lost[1] == 0 and lost[None] == 0 and lost[2] == len(text.split())


@pytest.mark.parametrize("size", [1, 4])
def test_keys_that_fill_chunks(spark, monkeypatch, size):
    """Rows of one key (or without one) are split over chunks and tasks; equal keys still take nothing from each other."""
    monkeypatch.setattr(census, "CHUNK", 600)
    texts = [*sentences(41, 60, 30), *sentences(41, 60, 30), *sentences(43, 30, 30), ""]
    random.Random(1).shuffle(texts)
    ids = [(None, 7, 7, k, 8)[k % 5] for k in range(len(texts))]
    chunks = census.chunked(frame(spark, texts, ids=ids).repartition(4), "doc_id", "text").collect()
    held = defaultdict(list)
    for r in sorted(chunks, key=lambda r: r["row"]):
        held[r["chunk"]].append(len(r["text"]) + census.ROW)
    assert all(len(x) == 1 or sum(x) <= 600 for x in held.values())
    for key in (None, 7, 8):
        assert len({r["chunk"] for r in chunks if r["key"] == key}) > 3
    keys = [-1 if r["key"] is None else r["key"] for r in sorted(chunks, key=lambda r: r["row"])]
    assert keys == sorted(keys) and len(keys) == len(texts)
    first = {}
    for i, t in zip(ids, texts):
        for win in windows(t, size)[1] if i is not None else ():
            first[win] = min(i, first.get(win, i))
    expected = Counter()
    for i, t in zip(ids, texts):
        w, wins = windows(t, size)
        gone = {p for k, win in enumerate(wins) if i is not None and first[win] < i for p in range(k, k + size)}
        expected[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    rows = substrings.remove_repeated(frame(spark, texts, ids=ids).repartition(4), size).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows) == expected
    assert sum(n > 0 for _, _, n, _ in expected) > 5
    linked = ngram_join.linked_groups(frame(spark, texts, ids=ids), 4, 85).collect()
    assert len(linked) == len(texts) and sum(r["first"] for r in linked) == len(set(texts))


def test_long_runs_are_hashed_in_blocks(monkeypatch):
    words = pa.array(["ab cd", "x" * 50 + " ab", "", "cd ab\ncd"])
    whole = shared.word_hashes(words)
    monkeypatch.setattr(shared, "BLOCK", 7)
    for a, b in zip(whole, shared.word_hashes(words)):
        assert a.tolist() == b.tolist()
    base = 0xD6E8FEB86659FD93
    at = np.array([5, (1 << 28) - 1, 1 << 28, (3 << 28) + 70_001])
    assert shared._power(at).tolist() == [pow(base, int(k), 1 << 64) for k in at]
    assert (shared._power(at) * shared._power(at, inverse=True)).tolist() == [1] * 4
    far = np.broadcast_to(np.uint8(0), (1 << 28) + 9)  # more than 2**28 values
    monkeypatch.setattr(shared, "BLOCK", 1 << 22)
    a, b = shared.run_hashes(far, np.array([3, 1 << 28]), np.array([9, (1 << 28) + 6]), shared._byte_values(False))
    assert a == b


def test_leaks_as_brute_force(spark, odd_texts):
    items = [" ".join(t.split()[:30]) for t in sentences(11, 6, 50)] + ["one two", None, ""]
    items = [t if t is None or len(t.split()) != 1 else t for t in items]
    near = items[0].split()
    near[0] = "changed"
    texts = [*odd_texts, f"{odd_texts[3]} {items[0]} {odd_texts[4]}", f"x {' '.join(near)} y", f"one two {odd_texts[5]}",
             f"{items[2]}\n{items[2]} {items[3]}"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = lambda t: WORD.findall((t or "").lower())
    grams = lambda w, n: Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    expected = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, item in enumerate(items):
            own = words(item)
            if not own:
                continue
            n = min(5, len(own))
            mine = grams(own, n)
            for s in range(len(w) - len(own) + 1):
                other = grams(w[s:s + len(own)], n)
                both = sum((mine & other).values())
                score = both / (sum(mine.values()) + sum(other.values()) - both)
                if score >= 0.8:
                    expected[d, i] = max(score, expected.get((d, i), 0))
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(frame(spark, texts), bench).collect()}
    assert found == pytest.approx(expected) and len(expected) >= 4


def test_leaks_at_the_edges(spark):
    """Items without their first or last words, where the document begins or ends, by brute force over clamped windows."""
    items = [" ".join(t.split()[:40]) for t in sentences(61, 12, 80) if len(t.split()) >= 40][:3]
    w, tails = [t.split() for t in items], sentences(62, 6)
    texts = [" ".join(w[0][:37]), " ".join(w[0][3:]), " ".join(w[1][2:38]), f"{tails[0]} {' '.join(w[1][:36])}", f"{' '.join(w[2][4:])} {tails[1]}",
             " ".join(w[2][:30]), f"{tails[2]} {' '.join(w[0][:20])}", f"{' '.join(w[2][5:])} {items[0]} {' '.join(w[1][:35])}", *tails]
    grams = lambda x: Counter(tuple(x[i:i + 5]) for i in range(len(x) - 4))
    expected = {}
    for d, t in enumerate(texts):
        own = t.split()
        for i, item in enumerate(w):
            mine = grams(item)
            for s in range(1 - len(item), len(own)):
                other = grams(own[max(0, s):max(0, s + len(item))])
                both = sum((mine & other).values())
                score = both / (sum(mine.values()) + sum(other.values()) - both)
                if score >= 0.8 and score > expected.get((d, i), (0, 0))[0]:
                    expected[d, i] = score, max(0, s)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.contaminated(frame(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == pytest.approx({k: v[0] for k, v in expected.items()})
    assert {(r["doc_id"], r["item_id"]): r["start"] for r in found} == {k: v[1] for k, v in expected.items()}
    assert {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (7, 0), (7, 1), (7, 2)} <= set(expected) and len(found) == len(expected)


def test_leaks_are_told_by_row(spark, tmp_path):
    """Rows that share a doc_id, or have none, with a row that leaks are kept; each row gets its own windows only."""
    import corpus_pipeline as pipeline

    items = [" ".join(t.split()[:30]) for t in sentences(51, 8, 60) if len(t.split()) >= 30][:2]
    clean = sentences(52, 12)
    texts = [*clean, f"{clean[0]} {items[0]} {clean[1]}", f"{clean[2]} {items[1]} {clean[3]}", f"{clean[4]} {clean[5]} {items[0]}"]
    ids = [(None, 7, k)[k % 3] for k in range(12)] + [None, 7, None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, texts, ids=ids)
    kept = pipeline.without_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == sorted(clean)
    found = decontamination.contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    starts = [len(clean[0].split()), len(clean[2].split()), len(f"{clean[4]} {clean[5]}".split())]
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in found} == {(None, 0, min(starts[0], starts[2])), (7, 1, starts[1])}
    assert len(found) == 2 and all(r["similarity"] == 1 for r in found)


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header>Site</header>
      <nav><ul><li><a href="/">Home</a><li><a href=x>More</a></ul></nav><div class="cookie-notice">We use cookies, many of them.</div>
      <div id=main><h1>Big &amp; small</h1><p>First <b>bold</b>er   text, long enough to count.<p>Second&nbsp;one<br>after a break &lt;here&gt;
      <aside>see also</aside></p></div><div class="comments"><p>Nice article, I liked all of it very much, thank you.</p></div>
      <form><p>Subscribe now to our wonderful letter</p></form><footer>&copy; us</footer>"""
    assert html_text.main_text(page) == "Big & small First bolder text, long enough to count. Second one after a break <here>"
    assert html_text.main_text("") == "" and html_text.main_text("just text") == "just text"
    assert html_text.main_text("<article><p>a<b>b</article><p>menu") == "ab"
    assert html_text.main_text("<p>x < y &unknown; <") .startswith("x < y &unknown;")
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("start, end", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<div id='content' class='no-share'>", "</div>"), ("<form id='aspnetForm'>", "</form>"),
    ("<div class=sidebar>", "</div>"), ("<div class='social'><form id=f><div class='no-comments page'>", "</div></form></div>"), ("<nav>", "")])
@pytest.mark.parametrize("named", [True, False])
def test_wrappers_do_not_hide_the_article(start, end, named):
    body = "<h1>A title</h1><p>The story goes on for a while and says a lot.</p><p>Then it ends, as stories do, with a moral.</p>"
    body = f"<article>{body}</article>" if named else f"<div>{body}</div>"
    around = "<div class='sidebar'>Other things to see</div><div class='share'>Tell your friends</div>"
    page = f"<body>{start}{body}{around}{end}<footer>(c) us, all rights</footer></body>"
    text = "A title The story goes on for a while and says a lot. Then it ends, as stories do, with a moral."
    if named or start != "<nav>":
        assert html_text.main_text(page) == text


def test_long_comments_and_lists_of_cards_stay_out():
    story = "<div id=story><p>A short story that is told here in full.</p></div>"
    comments = "<div class='comments'>" + "<p>I liked this very much and have a lot to say about it.</p>" * 5 + "</div>"
    assert html_text.main_text(story + comments) == "A short story that is told here in full."
    cards = "<div class='related posts'>" + "<article><p>Another one</p></article>" * 3 + "</div>"
    assert html_text.main_text(story + cards) == "A short story that is told here in full."
    assert html_text.main_text(f"{story}<div class='page' hidden><article><p>{'not shown ' * 50}</p></article></div>") == "A short story that is told here in full."


MENU = "<div><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>Sport</a></div>"
ADVERT, RIGHTS = "<div>Buy this now</div>", "<div>(c) us, all rights</div>"


def paragraphs(word, n, words=12):
    texts = [f"{' '.join([word] * words)} {i}." for i in range(n)]
    return "".join(f"<p>{t}</p>" for t in texts), " ".join(texts)


@pytest.mark.parametrize("start, end", [("", ""), ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>")])
def test_density_alone_finds_the_article(start, end):
    body, text = paragraphs("story", 5)
    page = f"{start}{MENU}{ADVERT}<div><h1>A title</h1>{body}</div>{RIGHTS}{end}"
    assert html_text.main_text(page) == f"A title {text}"
    teasers = "<div>" + "<article><h3><a href=x>Card</a></h3><p>More to read</p></article>" * 3 + "</div>"
    assert html_text.main_text(f"{start}<div>{body}</div>{teasers}{end}") == text
    teaser = "<article><h3>Card</h3><p>More</p></article>"
    assert html_text.main_text(f"{start}<div>{body}</div>{teaser}{end}") == text
    linked = "<div>" + "<a href=x><div>Read on</div><p>More to read</p></a>" * 3 + "</div>"
    assert html_text.main_text(f"{start}<div>{body}</div>{linked}{end}") == text


def test_density_leaves_no_part_of_the_article_out():
    (one, first), (two, second), (talk, talked) = paragraphs("one", 10, 60), paragraphs("two", 3, 50), paragraphs("hi", 30, 8)
    assert html_text.main_text(f"<div>{one}</div><div>{two}</div>") == f"{first} {second}"
    assert html_text.main_text(f"{MENU}<div>{one}</div><div>{talk}</div>") == f"{first} {talked}"
    assert html_text.main_text(f"{MENU}<div>{one}</div><div><h2>End</h2><p>Short.</p></div>") == f"{first} End Short."
    assert html_text.main_text(f"{MENU}<h1>Title</h1><div>By us</div><div>{one}</div>") == f"Title By us {first}"
    assert html_text.main_text(f"{MENU}<div>{one}</div><p><a href=x>one link</a></p><div>{two}</div>") == f"{first} one link {second}"
    assert html_text.main_text(f"<article>{one}</article><article>{one}</article>{MENU}") == f"{first} {first}"
    assert html_text.main_text(f"<main>{MENU}<p>Lead</p><div>{one}</div><div>Last words.</div></main>") == f"Lead {first} Last words."
    assert html_text.main_text(f"<article><p>By us</p><div>{one}</div><div>Last words.</div></article>{MENU}") == f"By us {first} Last words."
    assert html_text.main_text(f"<div><a name=top><a href=/x>Home<div>{one}</div></div>") == first
    assert html_text.main_text("<p><a href=1>One link</a></p><p><a href=2>Two link</a></p>") == "One link Two link"


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "<p>é a</p>", 1), (2, None, "<p>é a</p>", 1), (None, "v", "", 1)],
                                  "page_id long, url string, html string, n_chars int")
    rows = sorted(tuple(r) for r in html_text.extract(pages).na.fill({"page_id": -1, "url": ""}).collect())
    assert rows == [(-1, "v", "", 0), (1, "u", "", 0), (2, "", "é a", 3), (2, "", "é a", 3)]


def test_token_counts(spark, odd_texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rows = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, odd_texts), PIECE_BPE, 100).collect()}
    for k, t in enumerate(odd_texts):
        n = len(model.encode(t or ""))
        assert tuple(rows[k]) == (k, len((t or "").encode()), n, n > 100)


def test_proved_words_are_whole_tokens():
    model = token_counts.loaded(PIECE_BPE)
    assert model.apart and len(model.proved) > 10_000
    for word in sorted(model.proved)[::500]:
        assert len(model.model.encode(word)) == 1


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(spark, shards):
    texts = sentences(6, 400, 30) + ["same text here " * 5] * 200 + [None, ""]
    rows = sharding.shard_by_bytes(frame(spark, texts, ids=[1] + [*range(1, len(texts))]), shards, tolerance=0.02).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(sizes) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 8 for t in texts)
    assert max(sizes.values()) - min(sizes.values()) <= 0.08 * sum(sizes.values()) / shards + 2 * largest
    total = {(r["size"], r["text_crc32"]) for r in rows}
    assert total == {(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts}


def test_equal_texts_share_a_shard(spark):
    texts = [t for t in sentences(8, 300) for _ in range(2)]
    docs = frame(spark, texts)
    rows = sharding.shard_by_bytes(docs, 4).join(docs.select("doc_id", "text"), "doc_id").collect()
    where = defaultdict(set)
    for r in rows:
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_shards_hold_whole_rows(spark, tmp_path, monkeypatch):
    """Text and all other columns lie in the shards, also of rows whose doc_id is missing or repeated."""
    monkeypatch.setattr(sharding, "TASK_BYTES", 2000)
    texts = [*sentences(31, 200), *["same text"] * 60, None, ""]
    ids = [(None, 7, k)[k % 3] for k in range(len(texts))]
    docs = frame(spark, texts, ids=ids, sources=[f"s{k}" for k in range(len(texts))]).repartition(3)
    rows = sharding.shard_by_bytes(docs, 4, target=f"file://{tmp_path}/out").collect()
    assert Counter(tuple(r["carry"]) for r in rows) == Counter(tuple(r) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        whole = (r["carry"]["text"] or "").encode()
        assert (r["doc_id"], r["size"], r["text_crc32"]) == (r["carry"]["doc_id"], len(whole) + 8, zlib.crc32(whole))
        slots[r["shard"]].append((r["slot"], r["carry"]["source"]))
    for k, held in slots.items():
        assert [slot for slot, _ in sorted(held)] == list(range(len(held)))
        files = spark.read.parquet(f"file://{tmp_path}/out/shard={k}").orderBy("at").collect()
        assert [r["carry"]["source"] for r in files] == [source for _, source in sorted(held)]


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_packing(spark, odd_texts, weights):
    texts = [*odd_texts, *sentences(12, 80)]
    sources = [("a", "b", None)[k % 3] if weights is None else "ab"[k % 2] for k in range(len(texts))]
    rows = packing.pack(frame(spark, texts, sources=sources).repartition(3), BYTE_BPE, length=128, unit=32, weights=weights).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
    for k, t in enumerate(texts):
        ids, at = tokens_of(t), 0
        for start, length, crc, n in sorted(by_doc[k]):
            assert start == at and length > 0 and n == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)
    ends = sorted(by_sequence)
    assert ends == list(range(len(ends)))
    for s in ends:
        at = 0
        for offset, length, _ in sorted(by_sequence[s]):
            assert offset == at
            at += length
        assert at == 128 or s == ends[-1] and at <= 128
    if weights is None:  # after any number of sequences a source is near its share
        total, seen = Counter(), Counter()
        for s in ends:
            for _, n, source in by_sequence[s]:
                total[source] += n
        whole = sum(total.values())
        for s in ends[:-1]:
            for _, n, source in by_sequence[s]:
                seen[source] += n
            assert all(abs(seen[x] - (s + 1) * 128 * total[x] / whole) <= 32 * (len(total) + 1) for x in total)


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert write_token_files(docs, BYTE_BPE, target=str(tmp_path / "none")).count() == 0
    assert language.fit(docs) is None and language.predict(docs, None).count() == 0
    assert quality.quality(docs).count() == 0
    assert ngram_join.linked_groups(docs).count() == 0
    assert substrings.remove_repeated(docs).count() == 0
    assert decontamination.contaminated(docs, bench).count() == 0
    assert decontamination.contaminated(frame(spark, ["a b"]), bench).count() == 0
    assert token_counts.token_counts(docs, PIECE_BPE).count() == 0
    assert sharding.shard_by_bytes(docs).count() == 0
    assert packing.pack(docs, BYTE_BPE).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    base = sentences(21, 40, 120)
    leak = " ".join(base[5].split()[:30]) or base[5]
    passage = " ".join(" ".join(sentences(22, 4, 40)).split()[:60])
    texts = [*base, base[7], base[7] + " more", None, "123 456", f"{base[9]} {leak} {base[10]}", f"{passage} {base[11]}", f"{base[12]} {passage}"]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = len(base)
    assert set(range(n + 7)) - set(kept["language_id"]) == {n + 2, n + 3}
    assert n not in kept["ngram_jaccard_join"] and 7 in kept["ngram_jaccard_join"]
    cut = kept["substring_dedup"]
    assert passage in cut[n + 5] and passage not in cut[n + 6] and cut[0] == base[0]
    assert not {5, n + 4} & set(kept["benchmark_decontamination"])
    assert set(range(n)) - {5} <= set(kept["benchmark_decontamination"])
    assert {r["doc_id"] for r in docs.collect()} == set(kept["benchmark_decontamination"])
