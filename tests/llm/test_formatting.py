"""Chat windows, phrase mining and fill-in-middle against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dockledger.llm import chat, infill, phrases
from dockledger.llm.marks import check_marks

DOCS = "doc_id long, text string, lang string"
TURNS = "conv_id long, turn long, role string, text string"


# --- marks ------------------------------------------------------------------

@pytest.mark.parametrize("marks", [["<a>", "<a>"], [""], ["ab", "ba"], ["aba"], ["<<s>", "<s>"]])
def test_marks_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        check_marks(marks)


# --- fill in middle ---------------------------------------------------------

MARKS = infill.Sentinels().encoded()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "\n", "<", "P>", "é", "<S", "M", ">", "𝄞"]), max_size=30), st.data())
def test_rotations_undo_exactly(parts, data):
    text = "".join(parts).encode()
    if any(m in text for m in MARKS):
        return
    cuts = [int(c) for c in infill.line_cuts(text)]
    assert [text[a:b] for a, b in zip(cuts, cuts[1:])] == re.findall(rb"[^\n]*\n|[^\n]+", text)
    first, second = sorted(data.draw(st.sampled_from(cuts)) for _ in range(2))
    p, m, s = text[:first], text[first:second], text[second:]
    psm = infill.transform(text, first, second, infill.PSM, MARKS)
    spm = infill.transform(text, first, second, infill.SPM, MARKS)
    assert psm == b"<P>" + p + b"<S>" + s + b"<M>" + m
    assert spm == b"<S>" + s + b"<P>" + p + b"<M>" + m
    assert infill.restore(bytes(psm), infill.PSM, MARKS) == text
    assert infill.restore(bytes(spm), infill.SPM, MARKS) == text


def infill_rows():
    rng = random.Random(2)
    lines = ["one", "", "deux é", "<P", "x" * 50]
    texts = [None, "", "\n", "no end", "has <M> inside", "a\nb\n", "\n".join(rng.choices(lines, k=60_000))]
    texts += ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return [*rows, rows[-1], (None, "a\nb\nc", None), (None, None, None)]


def by_hand(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (0, 100)])
def test_fill_in_middle_against_brute_force(spark, rate, spm):
    rows = infill_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns(
        {"N": F.lit("mine"), "output": F.lit(1), "restored": F.lit(2), "__draw": F.lit("mine")}
    )
    made = infill.restored(infill.fill_in_middle(docs, rate=rate, spm=spm))
    assert made.columns == ["doc_id", "text", "lang", "__draw", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made.collect()]
    assert Counter(got) == Counter(by_hand(d, t, rate, spm) for d, t, _ in rows)


def test_fill_in_middle_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert infill.infill_report(empty).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(empty.withColumnRenamed("text", "output"), text="output")


# --- phrases ----------------------------------------------------------------

def mined(rows, longest=5, least=100, top=2000, cover=100):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = [w for w in re.findall(rb"[^\x20\x09]+", piece)]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            if not inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, b" ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda r: (-r[0], -r[1], r[2]))
        out += [
            (lang, i + 1, p.decode(), a, l, r, totals[lang], score)
            for i, (score, a, p, l, r) in enumerate(found[:top])
        ]
    return sorted(out)


def phrase_rows(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "New", "YORK", "a\xa0b", "in", "x", "É"] + [f"w{i}" for i in range(40)]
    weights = [30, 20, 10, 8, 8, 5, 9, 4, 4] + [1] * 40
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.choice([1, 3, 12, 60]))
        if i % 3 == 0:
            words += ["new", "york", "stock", "exchange", "of", "the"]
        text = "".join(w + rng.choice([" "] * 9 + ["\t", ", ", ". ", "\n", " \x0b", ";"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "fr", None])))
    rows += [(n, None, "en"), (n, "", None), (None, "new york " * 20_000, "de"), (n, " .,; ", "en")]
    return rows + rows[:5]


@pytest.mark.parametrize("longest, least, top, cover, every", [(5, 20, 2000, 100, 16), (3, 5, 10, 60, 1), (5, 5, 50, 90, 3), (2, 5, 2000, 100, 4)])
def test_collocations_against_brute_force(spark, longest, least, top, cover, every):
    rows = phrase_rows(longest * least)
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({"phrase": F.lit("mine"), "n": F.lit(1), "a": F.lit(2)})
    got = phrases.collocations(docs, longest, least, top, cover, every)
    assert sorted(map(tuple, got.collect())) == mined(rows, longest, least, top, cover)


def chunked(pieces, overlap, every):
    """The chunks of pieces of words, and whether each is the last of its piece."""
    words = pa.array([b"\n", *[w for p in pieces for w in [*p, b"\n"]]], pa.binary())
    names, ids = phrases.numbered(words)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in names.to_pylist()], np.uint64)[ids]
    starts, ends, last = phrases.chunk_bounds(hashes, ids == 0, overlap, every)
    texts = phrases.joined(words, starts, ends - starts).to_pylist()
    return [(text.split(b" "), bool(end)) for text, end in zip(texts, last)]


def runs(words, longest, starts=None):
    starts = len(words) if starts is None else starts
    return Counter(tuple(words[i : i + s]) for s in range(1, longest + 1) for i in range(starts) if i + s <= len(words))


@pytest.mark.parametrize("overlap", [1, 2, 4])
@pytest.mark.parametrize("every", [1, 2, 5])
def test_each_run_of_words_starts_in_one_chunk(overlap, every):
    rng = random.Random(overlap * 10 + every)
    pieces = [[rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(n)] for n in [1, 0, 2, 3, 5, 0, 0, 6, 40, 1, 300]]
    want, got = Counter(), Counter()
    for piece in pieces:
        want += runs(piece, overlap + 1)
    for chunk, last in chunked(pieces, overlap, every):
        assert b"\n" not in chunk
        got += runs(chunk, overlap + 1, len(chunk) if last else len(chunk) - overlap)
    assert got == want


def test_equal_passages_are_the_same_chunks_after_a_trigger():
    rng = random.Random(9)
    shared = [b"s%d" % rng.randint(0, 50) for _ in range(200)]
    before = [[b"x%d" % rng.randint(0, 50) for _ in range(n)] for n in (3, 17)]
    sets = [{tuple(c) for c, _ in chunked([[*b, *shared]], 4, 4)} for b in before]
    assert len(sets[0] & sets[1]) > 0.8 * len(sets[0]) > 20


def test_a_full_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(phrases.Frequent.__init__, "__defaults__", (3 + 5,))
    rows = phrase_rows(1, 120)
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, phrases.collocations(docs, 4, 5, 99).collect())) == mined(rows, 4, 5, 99)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, " . ", "en")], DOCS)).collect() == []


# --- chat -------------------------------------------------------------------

PARTS = ["<s>", "</s>", "<", "\\", "[INST]", "[/INST]", "[", "INST]", "\n", "<<SYS>>", "<</SYS>>", "<|im_start|>", "|>", "a", "é", "\\n", "n", ">", "s", "/"]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(3)
    template = chat.Template()
    texts = ["", *PARTS, *["".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(3000)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", template.escape(F.col("t")).alias("e"), template.role(F.col("t")).alias("r")
    ).select("*", template.unescape(F.col("e")).alias("back"), template.plain_role(F.col("r")).alias("role"))
    rows = df.collect()
    assert all(r["back"] == r["t"] and r["role"] == r["t"] for r in rows)
    assert not any(m in r[c] for r in rows for m in template.marks for c in "er")
    assert not any("\n" in r["r"] for r in rows)
    assert len({r["e"] for r in rows}) == len(set(texts))


def conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        n = 700 if conv == 7 else rng.choice([1, 2, 3, 6, 15, 40])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "assistant", "tool", None, "a\nb\\"])
            role = "system" if (turn == 0 and rng.random() < 0.5) or rng.random() < 0.02 else role
            text = None if rng.random() < 0.03 else "".join(rng.choices(PARTS + [" ", "word "], k=rng.randint(0, 40)))
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
    rows += [(100, 0, "user", "word " * 30_000), (100, 1, "assistant", "long " * 30_000), (101, 0, "system", "s " * 500)]
    rows += [(101, 1, "assistant", "x"), (101, 1, "assistant", "x"), (101, 1, "assistant", "w")]
    return rows


TOKEN = re.compile(r"[^\W\d_]+|\d|[^\s\w]|_")


def windows_by_hand(rows, budget, history, block):
    """first_turn -> (positions of the repeated turns, positions of the new ones), by conversation."""
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in grouped.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        cost = [chat.TURN_TOKENS + len(TOKEN.findall(t[3])) for t in turns]
        head = turns[0][2] == "system"
        found, at = {}, 0
        while at < len(turns):
            past, used = [], 0
            for j in range(at - 1, 0 if head else -1, -1):
                if used + cost[j] > history:
                    break
                past.insert(0, j)
                used += cost[j]
            used += cost[0] if head else 0
            new = [at]
            used += 0 if head and at == 0 else cost[at]
            while new[-1] + 1 < len(turns) and (new[-1] + 1) % block and used + cost[new[-1] + 1] <= budget:
                new.append(new[-1] + 1)
                used += cost[new[-1]]
            found[at + 1] = ([0] if head and at else []) + past, new, used
            at = new[-1] + 1
        out[conv] = turns, found
    return out


@pytest.mark.parametrize("budget, history, block, limit", [(120, 30, 256, None), (60, 0, 5, None), (200, 100, 8, None), (120, 40, 16, "50")])
def test_windows_against_brute_force(spark, budget, history, block, limit):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURNS).repartition(4).withColumns({"n": F.lit("mine"), "at": F.lit(0), "block": F.lit(1)})
    if limit:
        spark.conf.set("spark.dockledger.maxGroupRows", limit)
    try:
        windows = chat.read_window(chat.format_windows(turns, budget, history, block=block)).select(
            "*", chat.learned().alias("learned")
        ).collect()
        read = chat.read_turns(chat.format_windows(turns, budget, history, block=block)).collect()
    finally:
        spark.conf.unset("spark.dockledger.maxGroupRows")
    want = windows_by_hand(rows, budget, history, block)
    got = {(w["conv_id"], w["first_turn"]): w for w in windows}
    assert set(got) == {(c, first) for c, (_, found) in want.items() for first in found}
    for conv, (all_turns, found) in want.items():
        for first, (past, new, used) in found.items():
            window = got[conv, first]
            assert [tuple(t) for t in window["turns"]] == [all_turns[i][2:] for i in past + new]
            assert (window["n_repeated"], window["last_turn"], window["tokens"]) == (len(past), new[-1] + 1, used)
            assert window["learned"] == [all_turns[i][3] for i in new if all_turns[i][2] == "assistant"]
    assert Counter(map(tuple, read)) == Counter(
        (c, i + 1, *t[2:]) for c, (all_turns, _) in want.items() for i, t in enumerate(all_turns)
    )


def test_report_reads_back_from_windows(spark):
    rows = [*conversations(8), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in chat.format_report(spark.createDataFrame(rows, TURNS), 150, 50).collect()}
    for conv, (turns, _) in windows_by_hand(rows, 150, 50, 256).items():
        body = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        row = got.pop(conv)
        assert row["turns_sha256"] == hashlib.sha256(body.encode()).hexdigest()
        assert (row["n_turns"], row["loss_chars"]) == (len(turns), len(loss))
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert row["formatted_chars"] >= len(body)
    assert got == {}


def test_windows_of_nothing_and_bad_settings(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat.format_windows(empty).collect() == []
    assert chat.format_report(empty).collect() == []
    for budget, history, block in [(0, 0, 1), (10, 10, 1), (10, 5, 0)]:
        with pytest.raises(ValueError):
            chat.format_windows(empty, budget, history, block=block)


def test_a_callers_token_count_sets_the_windows(spark):
    turns = spark.createDataFrame([(1, i, "user", "x") for i in range(10)], TURNS)
    one = chat.format_windows(turns, budget=54, history=0, tokens=F.lit(5)).collect()
    assert [(w["first_turn"], w["last_turn"], w["tokens"]) for w in one] == [(1, 6, 54), (7, 10, 36)]
