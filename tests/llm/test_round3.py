"""Filter audit, embedding groups and vector codes against brute force, and their results for odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import embedding_groups, filter_audit, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


@pytest.mark.parametrize("at_once", [1, 7, 64, None])
def test_transducer_equals_regular_expressions(at_once):
    rng = random.Random(3)
    texts = ["", " ", "a", "a a", "é\x00A# b", "x" * 100 + " " + "x" * 100 + " " + "x" * 101, "　 　 a\x1cb"]
    texts += ["".join(rng.choices("aAb #é中\n\U0001F600", k=rng.randint(0, 60))) for _ in range(300)]
    assert filter_audit.measured(pa.array(texts), at_once).tolist() == [measured(t) for t in texts]


def test_equal_hashes_are_told_apart_by_bytes():
    data = np.frombuffer(b"abcdefgh1 abcdefgh2 abcdefgh1 " + b"z" * 80 + b" " + b"z" * 79 + b"y " + b"z" * 80, np.uint8)
    starts = np.array([0, 10, 20, 30, 111, 192])
    ends = np.array([9, 19, 29, 110, 191, 272])
    table = filter_audit.SpanTable(data, 2)
    first = table.insert(np.zeros(6, np.int64), starts, ends, np.zeros(6, np.uint64))
    assert first.tolist() == [True, True, False, True, True, False]
    assert not table.insert(np.zeros(1, np.int64), starts[:1], ends[:1], np.zeros(1, np.uint64))[0]
    assert table.insert(np.ones(1, np.int64), starts[:1], ends[:1], np.zeros(1, np.uint64))[0]  # another row


def test_long_text_of_tens_of_megabytes():
    words = [f"w{k * 7919 % 300_000}" for k in range(4_000_000)]
    text = " ".join(words)
    assert len(text) > 20_000_000
    assert filter_audit.measured(pa.array([text]))[0].tolist() == [len(words), len(set(words)), 0, len(text), 0]


AUDIT = "doc_id long, text string, lang string, quality int, kept string, n_words int, _key int, row int"
MARKS = "doc_id long, quality int, toxic int, lang string"


def audit_rows(rng):
    texts = [" ".join(rng.choices(["w%d" % k for k in range(rng.choice([3, 500]))], k=rng.choice([2, 150, 250])))
             + rng.choice(["", " #", " CAPITALS" * 9]) for _ in range(25)]
    texts += [None, "", None]
    return [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""]), 1, "x", 5, 6, 7) for _ in range(160)]


def audited(rows, marks):
    """Every order walked row by row."""
    good = {m[0] for m in marks if m[1] == 1}
    toxic = {m[0] for m in marks if m[2] == 1}
    failing = []
    for doc, text, lang, *_ in rows:
        words, distinct, capitals, points, symbols = measured(text or "")
        fails = {"A"} if words < 200 else set()
        fails |= {"B"} if 100 * distinct < 50 * words else set()
        fails |= {"C"} if 100 * capitals > 3 * points else set()
        fails |= {"D"} if symbols else set()
        if doc is not None and any(r[0] is not None and r[0] < doc and (r[1] or "") == (text or "") for r in rows):
            fails.add("E")
        failing.append((lang or "", fails, doc is not None and doc in good, doc is not None and doc in toxic))
    out, shapley = {}, {}
    for order in permutations("ABCDE"):
        for part in {f[0] for f in failing}:
            left = [f for f in failing if f[0] == part]
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                everyone = [f for f in failing if f[0] == part]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f[1] for f in everyone) - len(gone), sum(f[1] == {name} for f in everyone),
                    sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_audit_equals_walking_every_order(spark):
    rng = random.Random(8)
    rows = audit_rows(rng)
    marks = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(50)]
    found = filter_audit.audit(spark.createDataFrame(rows, AUDIT).repartition(5), spark.createDataFrame(marks, MARKS)).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found} == audited(rows, marks)
    assert len(found) == 3 * 600


def test_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], AUDIT), spark.createDataFrame([], MARKS)).count() == 0
    lone = filter_audit.audit(spark.createDataFrame([(None,) * 8], AUDIT), spark.createDataFrame([], MARKS)).collect()
    assert len(lone) == 600 and {r["part"] for r in lone} == {""} and sum(r["removed"] for r in lone) == 120


VECTORS = "vec_id long, embedding array<float>, label int, node long, h1 int, size string, block int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x", 3) for i, v, label in rows], VECTORS).repartition(3)


def near_vectors(seed=5, dims=24):
    """Strangers, chains at the threshold, equal rows, one large group and odd rows."""
    rng, rows = np.random.default_rng(seed), []
    def add(v, label):
        rows.append((len(rows), None if v is None else [float(x) for x in v], label))
    for _ in range(500):
        add(rng.normal(size=dims), int(rng.integers(3)))
    for _ in range(25):
        base, turn = rng.normal(size=dims), rng.normal(size=dims)
        for k in range(4):
            add(base + 0.06 * k * turn, 1)
    base = rng.normal(size=dims)
    for _ in range(150):
        add(base + rng.normal(size=dims) * 0.08 * np.linalg.norm(base) / math.sqrt(dims), 2)
    for _ in range(20):
        add(base * 3, 2)
    add(base, 0)
    add(base, None)
    add(None, 2)
    add([0.0] * dims, 2)
    add([float("nan")] + [1.0] * (dims - 1), 2)
    add([float("inf")] + [1.0] * (dims - 1), 2)
    add([], 2)
    for _ in range(3):
        add([1.0, 2.0], 2)
    add([1.0, 2.1, 0.0], 2)
    rows.append((len(rows), [None, 1.0], 2))
    rows.append((None, list(map(float, base)), 2))
    rows.append((None, [9.0, -4.0, 1.0], 2))
    rows.append((700, rows[650][1], 2))
    return rows


def linked(rows, cosine):
    units = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        v = np.array(v, np.float32).astype(float) if ok else None
        units.append(v / np.linalg.norm(v) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
             and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def test_links_equal_all_cosines(spark, monkeypatch):
    monkeypatch.setattr(embedding_groups, "CHUNK", 40)  # the large group meets in several pieces of work
    monkeypatch.setattr(embedding_groups, "SMALL", 6)
    rows = near_vectors()
    found = embedding_groups.linked_vectors(vector_frame(spark, rows), recall=0.9999)
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(linked(rows, 0.98), key=order)


def test_recall_of_pairs_at_the_threshold(spark):
    rng, rows = np.random.default_rng(2), []
    for k in range(2000):
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b = rng.normal(size=32)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        turn = math.acos(0.9801)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (math.cos(turn) * a + math.sin(turn) * b).tolist(), 1)]
    found = embedding_groups.linked_vectors(vector_frame(spark, rows)).agg({"n_links": "sum"}).first()[0]
    assert found >= 0.99 * 4000


def test_rotation_is_one_and_balances_bits():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(2000, 12)) * np.linspace(1, 4, 12)
    rotation, level = embedding_groups.learned_rotation(sample, rng)
    assert np.allclose(rotation.T @ rotation, np.eye(12))
    assert np.abs((sample @ rotation > level).mean(0) - 0.5).max() < 0.01


def test_no_vectors(spark):
    assert embedding_groups.linked_vectors(vector_frame(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_groups.linked_vectors(vector_frame(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]
    assert vector_codes.encode(vector_frame(spark, [])).count() == 0
    assert vector_codes.encode(vector_frame(spark, [(4, None, 1), (5, [None], 1), (6, [float("nan")], 1)])).count() == 0


def coded(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd's rounds with Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    length = max((len(r[1]) for r in kept), default=0)
    width = max(1, -(-length // parts))
    numbers = [[math.floor(scale * x) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    pieces = [[n[p * width:(p + 1) * width] for p in range(parts)] for n in numbers]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[pieces[k][p] for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(x[p], books[p])[1] for x in pieces]
            for e in set(at):
                own = [x[p] for x, k in zip(pieces, at) if k == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for row, x in zip(kept, pieces):
        found = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((row[0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), row[2]))
    return [(i, code, error, sum(o[2] for o in out if o[3] == label), sha) for i, code, error, label in out]


@pytest.mark.parametrize("entries, rounds", [(256, 4), (7, 3), (1, 1)])
def test_codes_equal_plain_rounds(spark, entries, rounds):
    rng = np.random.default_rng(entries)
    rows = [(int(k), (rng.integers(-3, 4, size=16) / 8).tolist(), [None, 1, 2][k % 3]) for k in range(400)]
    rows += [(3, rows[3][1], 1), (None, rows[9][1], 2), (500, [0.5, 0.25], 1), (501, None, 1), (502, [float("nan")] * 16, 1), (503, [], None)]
    rows += [(504 + k, rows[1][1], 2) for k in range(40)]
    found = vector_codes.encode(vector_frame(spark, rows), entries=entries, rounds=rounds)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=order) == sorted(coded(rows, entries=entries, rounds=rounds), key=order)


def test_walk_finds_the_nearest_entry_and_skips_far_ones():
    rng = np.random.default_rng(4)
    centres = rng.integers(-10_000, 10_000, size=(16, 3))
    entries = (centres[np.arange(256) % 16] + rng.integers(-50, 50, size=(256, 3))).astype(np.int64)
    entries[200] = entries[17]  # equal entries: the lower index wins
    rows = entries[rng.integers(256, size=3000)] + rng.integers(-40, 40, size=(3000, 3))
    book = vector_codes.Codebook(entries)
    best, error = book.nearest(rows)
    apart = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert best.tolist() == apart.argmin(1).tolist() and error.tolist() == apart.min(1).tolist()
    assert book.compared < 0.3 * apart.size


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(6)
    entries = rng.integers(-(1 << 29), 1 << 29, size=(40, 4))
    rows = rng.integers(-(1 << 29), 1 << 29, size=(200, 4))
    best, error = vector_codes.Codebook(entries, 1 << 29).nearest(rows)
    apart = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert best.tolist() == apart.argmin(1).tolist() and error.tolist() == apart.min(1).tolist()
    huge = vector_codes.whole_numbers(pa.array([[3e38, -3e38, 0.5, None or 1.0]]), 4, 1024)[0]
    assert huge.tolist()[2:] == [512, 1024] and huge[0] == -huge[1] and 4 * (2 * int(huge[0])) ** 2 < 1 << 63


def test_registered_queries_give_the_columns_asked_for(spark):
    from tidemark.llm.queries import QUERIES

    wanted = {
        "op11_embedding_groups": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
                             "good_lost bigint, toxic_lost bigint, shapley bigint",
        "op13_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    }
    for name, columns in wanted.items():
        assert ", ".join(f"{c} {t}" for c, t in QUERIES[name](spark, "/root/testdata/sf0.001").dtypes) == columns


def test_staged_tables_are_removed_but_not_those_still_read(spark):
    from tidemark.llm.shared import drop_staged, recorded, staged

    with recorded() as outer:
        first = staged(spark.range(5), "first")
        with recorded() as inner:
            second = staged(first, "second")
        third = staged(second, "third")
    assert len(outer) == 3 and inner == outer[1:2]
    drop_staged(spark, outer, third)
    assert len(outer) == 1 and third.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(inner[0]).count()
    drop_staged(spark, outer)
    assert not outer


def test_equal_hashes_in_the_word_memory_are_told_apart():
    from tidemark.llm.bytebpe import Memory

    data = np.frombuffer(b"alphabeta", np.uint8)
    memory = Memory(np.dtype("<u2"))
    memory.add(np.array([7], np.uint64), [b"alpha"], [np.array([1, 2], "<u2").tobytes()])
    found = memory.find(np.array([7, 7, 8], np.uint64), data, np.array([0, 5, 0]), np.array([5, 9, 5]))
    assert found.tolist() == [0, -1, -1]
