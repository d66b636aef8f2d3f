"""The document operators against brute force, on texts with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from dockledger.llm import (
    components, decontaminate, lines, lm, packing, pii, quality, rules, sharding, simhash, suffixes,
)

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n):
    letters = "abcdefghijklmnoprstuvwéñü"
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))


def texts():
    """Null, empty, blank, short, very long, equal, nearly equal, periodic and repeated texts."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    base = [prose(rng, 120) for _ in range(30)]
    near = [b.replace(b.split()[50], "changed", 1) for b in base[:6]]
    shared = prose(rng, 40)
    out = [None, "", " \t\n ", "one", "ÉA ßs\x01x", long, long, "Der " * 900, "ab" * 400, "\n".join([shared] * 5)]
    out += base + base[:4] + near
    out += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(8)]
    out += ["\n".join([prose(rng, 9), shared, " " + shared.upper() + "\t", prose(rng, 2), "x"]) for _ in range(5)]
    return out


@pytest.fixture(scope="module")
def rows():
    got = [(i, t, "en", None if i % 3 else "s", len(t or "")) for i, t in enumerate(texts())]
    random.Random(1).shuffle(got)
    return got


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward(spark, rows):
    """Null ids, a repeated row, and columns called like those that the operators make."""
    some = [*rows[:12], rows[3], (None, "text without an id " * 9, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(some, SCHEMA)
    for name in ("size", "shard", "slot", "score", "n_words", "spans", "kept", "n_lines", "leaks", "fp", "__score",
                 "__words", "__t", "__kept", "doc", "hashes", "owner", "Rejected_By"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def test_shards_are_contiguous_and_near_equal(docs, rows):
    got = sorted(sharding.shard_documents(docs, 7).collect())
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    by = {r[0]: (r[1] or "").encode() for r in rows}
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(by[r["doc_id"]]) + 8, zlib.crc32(by[r["doc_id"]]))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(v == list(range(len(v))) for v in slots.values())
    largest = max(r["size"] for r in got)
    assert all(abs(sizes[k] - sum(sizes.values()) / 7) <= largest for k in range(7))


@pytest.mark.parametrize("shards", [1, 3, 8, 24])
def test_shard_of_a_row_is_where_its_middle_falls(spark, shards):
    rng = random.Random(shards)
    sizes = [rng.choice([0, 1, 5, 10**13]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k int, size long").repartition(5)
    got = {r["k"]: r["shard"] for r in sharding.assign_shards(df, ["k"], "size", shards).collect()}
    start, total = 0, sum(sizes)
    for k, size in enumerate(sizes):
        assert got[k] == min((2 * start + size) * shards // (2 * total), shards - 1)
        start += size


def test_written_shards_hold_the_documents(docs, rows, spark, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/shards", 3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_pieces_hold_every_id_once_and_sequences_are_gapless(docs, rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack_pieces(packing.token_pieces(docs, TOKENIZER, 256, with_ids=True).cache(), 256).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text, *_ in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[doc], key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == want
        assert {r["doc_tokens"] for r in pieces} == {len(want)}
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("word", [
    "AL\u0130", "TAR\u0130H\u0130", "\u0915\u095c", "\ufb2a", "na\u0308", "\u00c9t\u00e9", "\u039f\u0394\u039f\u03a3",
    "\u041c\u0438\u0440", "stra\u00dfe", "\u4e2d\u6587", "\ufb01", "I\u0307", "WORD", "\u0958",
])
@pytest.mark.parametrize("end", [",", ".", ".,", ""])
def test_words_before_a_stop_have_the_ids_of_the_whole_text(word, end):
    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), packing.WordEncoder(TOKENIZER)
    texts = [word + end, f"one {word}{end} two", f"{word}{end}\n{word}"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(8))
def test_histogram_packing_places_each_piece_by_the_rule(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 50, 300])
    histogram = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 30, 4000])))
    runs, sequences = packing.pack_histogram(histogram, capacity)
    fill, position = [0] * sequences, 0
    lengths = [n for n in sorted(histogram, reverse=True) for _ in range(histogram[n])]
    ends = [*runs[1:, 0], len(lengths)]
    for (first, seq, per, offset, length), end in zip(runs.tolist(), ends):
        assert first == position
        for i in range(end - first):
            at = seq + i // per
            assert lengths[position] == length and fill[at] == offset + i % per * length
            fill[at] += length
            position += 1
    assert position == len(lengths) and max(fill) <= capacity and min(fill) > 0
    # One piece at a time: the open sequence with the most room, or a new one.
    plain = []
    for n in lengths:
        k = min(range(len(plain)), key=plain.__getitem__, default=None)
        if k is None or plain[k] + n > capacity:
            plain.append(n)
        else:
            plain[k] += n
    assert sequences == len(plain)


def test_quality_scores_learn_and_stay_between_zero_and_one(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 60)) for i in range(0, 600, 2)]
    bad = [(i, " | ".join(prose(rng, 40).split()) + " ###") for i in range(1, 600, 2)]
    df = spark.createDataFrame([*good, *bad, (600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, 1 - i % 2) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int"
    )
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.97
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(df.repartition(5), labels).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}
    kept = quality.keep_good(df.withColumn("__score", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "__score"] and kept.count() < 400


def test_long_texts_are_judged_like_their_parts(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    known = labels.where(quality.held_out()).join(docs, "doc_id").orderBy("doc_id").select("quality", "text").collect()
    rows, want = [], {}
    for label in (0, 1):
        texts = [r["text"] for r in known if r["quality"] == label and r["text"]]
        for size in (1 << 16, 1 << 18, 1 << 20):
            for k in range(8):
                random.Random(k).shuffle(texts)
                joined = "\n".join(texts)
                joined = (joined * (1 + size // len(joined)))[:size]
                want[len(rows)] = label
                rows.append((len(rows), joined))
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: int(r["score"] >= 0.5) for r in got} == want


def test_quality_without_labels_is_even(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}


def counts(text):
    found = re.findall("[^\x20\x09-\x0D]+", text or "")
    ls = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    runs = defaultdict(list)
    for i in range(len(found) - 7):
        runs[tuple(found[i : i + 8])].append(i)
    repeated = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(repeated)
    )


def test_rule_counts_and_verdicts(docs, rows):
    got = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        r, want = got[doc], counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_order_of_rules_never_changes_what_is_rejected(docs):
    counted = rules.with_counts(docs)
    default = rules.default_rules()
    ordered = rules.estimate(docs, default)
    assert {r.name for r in ordered} == {r.name for r in default} and all(r.cost > 0 for r in ordered)
    for some in (ordered, default, default[::-1]):
        n = counted.where(rules.first_rejection(some).isNull()).count()
        assert n == counted.where(rules.first_rejection(default).isNull()).count()


def brute_repeats(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = True
            seen.add(piece)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [64, 100, 333])
def test_repeated_strings_go_byte_by_byte(docs, rows, length):
    want = brute_repeats([(r[0], r[1] or "") for r in rows], length)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeat_report(docs, length).collect()}
    assert got == want


def test_repeated_strings_with_null_and_repeated_ids(spark, rows):
    some = [(r[0], r[1] or "") for r in rows if len(r[1] or "") < 2000]
    again = [*some, *some[:5], (None, some[0][1]), (None, None)]
    df = spark.createDataFrame(again, "doc_id long, text string")
    got = suffixes.repeat_report(df).collect()
    order = sorted(again, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = brute_repeats([(i, t or "") for i, (_, t) in enumerate(order)], 100)
    assert sorted(map(repr, [(order[i][0], *v) for i, v in want.items()])) == sorted(map(repr, map(tuple, got)))


def shingle_print(text):
    found = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)] * bool(found)
    bits = Counter(b for s in runs for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in bits if 2 * bits[b] > len(runs))


def test_fingerprints_and_components(docs, rows):
    got = {r["doc_id"]: r for r in simhash.near_documents(docs).collect()}
    prints = {r[0]: shingle_print(r[1]) for r in rows}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == prints
    for doc in prints:
        group, new = set(), {doc}
        while new:
            group |= new
            new = {b for a in new for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2} - group
        assert got[doc]["component_id"] == min(group)


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_trees_find_all_close_pairs(spark, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = set(centres.tolist())
    for c in centres:
        for _ in range(15):
            flips = rng.choice(64, rng.integers(0, 8), replace=False)
            points.add(int(c) ^ sum(1 << int(b) for b in flips))
    points = np.array(sorted(points), dtype=np.uint64)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    edges = simhash.close_edges(df, radius, leaf=20).collect()
    label = {int(p): int(p) for p in points.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        assert (a ^ b & (1 << 64) - 1).bit_count() <= radius or bin((a ^ b) % (1 << 64)).count("1") <= radius
        label[root(a)] = root(b)
    for i, p in enumerate(points):
        for q in points[np.bitwise_count(points ^ p) <= radius]:
            assert root(int(p.view(np.int64))) == root(int(q.view(np.int64)))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (500, 400), (400, 500)]
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 100 for i in range(100, 161)} | {k: 1 for k in range(1, 40)} | {400: 400, 500: 400}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_documents_keep_one(docs, rows):
    kept = {r["doc_id"] for r in simhash.without_near_copies(docs).collect()}
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a in sets:
        others = [jaccard(a, b) for b in sets if b != a]
        if max(others) < 0.6:
            assert a in kept
        if any(jaccard(a, b) >= 0.85 for b in sets if b < a):
            assert a not in kept
    assert simhash.without_near_copies(docs).columns == docs.columns


def exact_groups(sets):
    """The smallest id that each document reaches over pairs of a Jaccard similarity of at least 0.8."""
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: top(d) for d in sets}


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_similar_documents_are_those_of_exact_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rng = random.Random(23)
    rows = []
    for base in range(60):  # pairs from about 0.6 to 1
        words = prose(rng, rng.choice([12, 60, 300, 900])).split()
        rows += [" ".join(words), " ".join(w if rng.random() > base / 600 else prose(rng, 1) for w in words)]
    words = prose(rng, 250).split()  # a crowd whose members are alike by chance only
    rows += [" ".join(w if rng.random() > 0.025 else prose(rng, 1) for w in words) for _ in range(40)]
    text = prose(rng, 300)
    rows += [text, f"{text} {text}", f"{text} {text} {text}", "a b c d", "a b c d e", "a b c d e f", "", None, " "]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    sets = {}
    for doc, text in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
    alike = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b]
    assert sum(0.6 < j < 0.8 for j in alike) > 50 and sum(0.8 <= j < 1 for j in alike) > 40
    kept = {r["doc_id"] for r in simhash.without_near_copies(docs).collect()}
    assert kept == {d for d, r in exact_groups(sets).items() if d == r}


def test_similar_documents_are_first_linked_by_close_fingerprints(spark, monkeypatch):
    rng = random.Random(29)
    rows = []
    for _ in range(30):  # copies with their last word changed, and one with a tenth of its words changed
        words = prose(rng, 400).split()
        rows += [" ".join(words)] + [" ".join([*words[:-1], f"end{k}"]) for k in range(3)]
        rows.append(" ".join(w if rng.random() > 0.1 else prose(rng, 1) for w in words))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    hashes = [np.unique(simhash.shingle_hashes(t, 5)) for t in rows]
    fps = [simhash.fingerprint(h) for h in hashes]
    close = {(a, b) for b in range(len(rows)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2}
    assert len(close) >= 60
    nodes = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "node long, fp long")
    got = {tuple(r) for r in simhash.fingerprint_pairs(nodes).collect()}
    assert got <= close
    joined = dict(components.connected(spark.createDataFrame(sorted(got), "a long, b long")).collect())
    assert all(joined[a] == joined[b] for a, b in close)

    # Without a min-hash bucket the tree's links alone take the close copies away, and no other document.
    monkeypatch.setattr(simhash, "bands", lambda hashes: np.empty(0, np.uint64))
    kept = {r["doc_id"] for r in simhash.without_near_copies(docs).collect()}
    assert kept == {i for i in range(len(rows)) if joined.get(i, i) == i}


def test_words_with_symbols_behind_known_letters_are_not_encoded_again(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), packing.WordEncoder(TOKENIZER, 50)
    monkeypatch.setattr(encoder, "known", [k.slice(0, 0) for k in encoder.known])
    texts = ["alpha beta école $$$ !?", "Alpha$$$ BETA!? alpha École$$$ alpha", "", None, "it's \x01 x\x01 1a ALİ, ΟΔΟΣ."]
    learned, learn = [], encoder._learned
    monkeypatch.setattr(encoder, "_learned", lambda new: (learned.extend(new.to_pylist()), learn(new))[1])
    encoder.encode(texts[:1])
    learned.clear()
    encoder.encode(texts[1:2])
    assert [w for w in learned if w] == []
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts * 30) == want * 30
    assert encoder.encode([]) == []


def luhn(number):
    ds = [int(c) for c in number][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(ds)) % 10 == 0


def test_personal_data_positions_and_checks(spark):
    cases = [
        "é a@b.com_x@y.com .@x.y, 1.2.3.4.5 300.1.2.3 01.002.255.0 1..2.3.4",
        "4111 1111 1111 1111 4111-1111-1111-1112 00000000000000 1" + "0" * 25 + " 4111  1111",
        "+1 (017) 555-7713, +12 +1234567890123456 +49 (30) 1234567 ñ +1.555.010.9999",
        "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "my ssn is 123-45-6789; other ssn 123-45-6789",
        "x" * 500 + " nothing here 123-45-6789 " + "y" * 60, "token = \"" + "0a" * 20 + "\"" + " z" * 60 + " " + "0a" * 20,
        "a@b.c " * 300, "9" * 5000, "a" * 5000 + "@b.c", None, "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    base = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (
            r"[0-9]([\x20-]?[0-9])+",
            lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        ),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    got = pii.personal_data(df).collect()
    for r in got:
        text, spans = cases[r["doc_id"]] or "", []
        for n, (kind, (pattern, check)) in enumerate(base.items()):
            hits = [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text) if check(m[0])]
            assert r[f"n_{kind}"] == len(hits), (r["doc_id"], kind)
            spans += hits
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    more = {r["doc_id"]: r["spans"] for r in got}
    assert more[3] == "iban:5:32" and more[4] == "ssn:10:21,ssn:33:44" and more[5] == "" and more[6] == "secret:9:49"
    masked = pii.mask(pii.find_spans(df)).where("doc_id = 4").first()["text"]
    assert masked == "my ssn is [ssn]; other ssn [ssn]"


def brute_lines(rows):
    strip, owner = " \t\n\x0b\x0c\r", {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for x in (text or "").split("\n"):
            owner.setdefault(key(x), doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        stay = [x for x in own if len(key(x)) < 10 or owner[key(x)] == doc]
        out.append((doc, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def test_lines_go_but_in_their_first_document(docs, rows):
    want = brute_lines([(r[0], r[1]) for r in rows])
    assert sorted(map(tuple, lines.line_report(docs).collect())) == sorted(want)
    cleaned = lines.without_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    assert cleaned.where("text is not null and n_chars <> char_length(text)").count() == 0


def test_lines_with_null_and_repeated_ids(spark, rows):
    again = [(r[0], r[1]) for r in rows] + [(rows[0][0], rows[0][1]), (None, rows[1][1]), (None, "a new line of text")]
    df = spark.createDataFrame(again, "doc_id long, text string")
    got = lines.line_report(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_lines(again)))


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_number_of_batches_changes_nothing(docs, batches):
    one = sorted(map(tuple, lines.drop_lines(docs, 3).select("doc_id", "n_dropped", "kept").collect()))
    assert sorted(map(tuple, lines.drop_lines(docs, batches).select("doc_id", "n_dropped", "kept").collect())) == one


def test_runs_are_compacted(spark):
    store = lines.LineStore(spark, fanout=2, buckets=3)
    for b in range(5):
        batch = spark.createDataFrame([(10 * b + k, k + b, 0) for k in range(6)], "doc long, h1 long, h2 long")
        dropped = {tuple(r)[1] for r in store.add(batch).collect()}
        assert dropped == (set() if b == 0 else {k + b for k in range(5)})
    assert [len(level) for level in store.levels] == [1, 0, 1]
    store.close()


def edited(rng, item, k):
    out = list(item)
    for _ in range(k):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["zzz"], [out[at], "yyy"]])
    return out


def test_edited_benchmark_passages_are_found_and_no_others(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([1, 5, 14, 30, 60, 130]))) for i in range(40)]
    cases = []
    for i, t in items * 4:
        words = edited(rng, t.split(), decontaminate.allowed(len(t.split())))
        cases.append(f"{prose(rng, 30)} {' '.join(words).upper()}, {prose(rng, 25)}")
    cases += [prose(rng, 200) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(df, benchmark).collect()}
    hashed = {i: decontaminate.word_hashes(t) for i, t in items}
    want = {}
    for d, t in enumerate(cases):
        words = decontaminate.word_hashes(t or "")
        for i, item in hashed.items():
            edits, _ = decontaminate.best_alignment(item, words)
            if edits <= decontaminate.allowed(len(item)):
                want[(d, i)] = edits
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    for k, r in got.items():
        assert r["edits"] == want[k]
        part = decontaminate.word_hashes(cases[k[0]])[r["at"] : r["at"] + r["n"]]
        assert decontaminate.best_alignment(hashed[k[1]], part)[0] == r["edits"]
    blocks = decontaminate.find_leaks(df, benchmark, items=7).select("doc_id", F.explode("leaks.item_id"))
    assert set(map(tuple, blocks.collect())) == set(got)
    left = decontaminate.without_leaks(df, benchmark)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(cases))) - {d for d, _ in got}


@pytest.mark.parametrize("where", ["front", "middle", "end", "anywhere"])
def test_passages_are_found_wherever_their_edits_lie(where):
    rng = random.Random(3)
    vocabulary = prose(rng, 5_000).split()
    items, texts = [], []
    for n in (12, 31, 40, 63, 96, 127):
        span = {"front": (0, n // 2), "middle": (n // 4, n - n // 4), "end": (n // 2, n), "anywhere": (0, n)}[where]
        for k in range(60):
            words = rng.choices(vocabulary, k=n)
            items.append((len(items), " ".join(words)))
            for at in sorted(rng.sample(range(*span), decontaminate.allowed(n)), reverse=True):
                words[at : at + (k % 3 != 1)] = rng.choices(vocabulary, k=int(k % 3 != 2))
            after = rng.choices(vocabulary, k=0 if k % 2 else 60)  # every other passage ends its text
            texts.append(" ".join([*rng.choices(vocabulary, k=60), *words, *after]))
    held = decontaminate.Items(
        [i for i, _ in items], [decontaminate.word_hashes(t) for _, t in items], decontaminate.EDITS
    )
    found = held.search([decontaminate.word_hashes(t) for t in texts])
    assert [k for k in range(len(items)) if all(m[0] != k for m in found[k])] == []


def plain_alignment(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_against_the_textbook():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        assert decontaminate.best_alignment(np.array(a), np.array(b))[0] == plain_alignment(a, b)


def test_losses_against_plain_counts(docs, rows, spark):
    labels = spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows] + [(None, 1), (8, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, labels).collect()}
    cut = {r[0]: lm.tokens(r[1] or "").tolist() for r in rows}
    slots = {d: lm.pairs(np.array(w, dtype=np.int64)).tolist() for d, w in cut.items()}
    for doc in list(cut)[::3]:
        if not cut[doc]:
            assert (got[doc]["n_tokens"], got[doc]["score"]) == (0, 0.0)
            continue
        mean = {}
        for name, keep in (("background_loss", lambda d: True), ("target_loss", lambda d: d % 2)):
            others = [d for d in cut if keep(d) and d != doc and cut[d]]
            single, double = Counter(), Counter()
            for d in others:
                single.update(cut[d])
                double.update(slots[d])
            total, loss = sum(single.values()), 0.0
            for i, (w, p) in enumerate(zip(cut[doc], slots[doc])):
                one = (single[w] + lm.ADDED) / (total + lm.ADDED * 2**lm.WORD_BITS)
                seen = single[cut[doc][i - 1]] if i else len(others)
                two = min(double[p] / seen, 1.0) if seen else one
                loss -= np.log(lm.PAIR_WEIGHT * two + (1 - lm.PAIR_WEIGHT) * one)
            mean[name] = loss / len(cut[doc])
            assert got[doc][name] == pytest.approx(mean[name], rel=1e-9)
        assert got[doc]["score"] == pytest.approx(mean["background_loss"] - mean["target_loss"], abs=1e-9)


OPERATORS = {
    "sharding": lambda d, s: sharding.shard_documents(d),
    "shards": lambda d, s: sharding.assign_shards(d.withColumn("w", sharding.text_bytes()), ["doc_id"], "w", 3),
    "packing": lambda d, s: packing.pack_documents(d, TOKENIZER),
    "quality": lambda d, s: quality.quality_scores(d, s),
    "keep_good": lambda d, s: quality.keep_good(d, s),
    "rules": lambda d, s: rules.judged(d),
    "cascade": lambda d, s: rules.cascade(d),
    "suffixes": lambda d, s: suffixes.repeat_report(d),
    "simhash": lambda d, s: simhash.near_documents(d),
    "near_copies": lambda d, s: simhash.without_near_copies(d),
    "pii": lambda d, s: pii.personal_data(d),
    "spans": lambda d, s: pii.mask(pii.find_spans(d)),
    "lines": lambda d, s: lines.line_report(d),
    "new_lines": lambda d, s: lines.without_repeated_lines(d),
    "leaks": lambda d, s: decontaminate.find_leaks(d, s.selectExpr("doc_id as item_id", "'some words' as text")),
    "without_leaks": lambda d, s: decontaminate.without_leaks(d, s.selectExpr("doc_id as item_id", "'w' as text")),
    "lm": lambda d, s: lm.cross_entropy_difference(d, s),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_awkward_rows(spark, empty, rows, name):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)], "doc_id long, quality int, toxic int")
    assert OPERATORS[name](empty, labels).count() == 0
    df = awkward(spark, rows)
    got = OPERATORS[name](df, labels).collect()
    if name not in ("packing", "keep_good", "near_copies", "without_leaks"):
        assert len(got) == df.count()
    none = labels.limit(0)
    assert OPERATORS[name](df, none).collect() is not None
