"""Toxicity, secrets, repeated passages, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sigwatch.llm import chunks, credentials, packing, simhash, toxicity
from tests.llm.test_simhash import components, plain_print

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, toxic int, score string, spans string, start int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "x", 0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    rows = (toxicity.toxicity(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
            .join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
            .join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id")
            .where("held_out").collect())
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    score, truth = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    higher = (score[truth == 1][:, None] > score[truth == 0][None, :]).mean()
    predicted = score >= 0.7
    assert higher > 0.88 and (truth[predicted] == 1).mean() > 0.95
    # In these tables only English texts show why they are called toxic.
    english = np.array([r.lang == "en" for r in rows])
    assert predicted[english & (truth == 1)].mean() > 0.88


def plain_probability(counts_by_order, preceded, word, kind):
    """Kneser-Ney by dictionaries, one letter at a time."""
    text, total = "\0" * (toxicity.ORDER - 1) + word + "\1", 0.0
    for at in range(toxicity.ORDER - 1, len(text)):
        chance = toxicity.FLOOR
        for n in range(1, toxicity.ORDER + 1):
            gram = text[at - n + 1:at + 1]
            counts = preceded if n <= toxicity.SHARED else counts_by_order[kind]
            same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1] and c > 0}
            held = sum(same.values())
            if held:
                chance = (max(same.get(gram, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * chance) / held
        total += np.log(chance)
    return total


def plain_counts(rows):
    """Per class: counts at the highest order, different letters before an n-gram at the others;
    and the shared ones, from all rows."""
    kinds, counts = defaultdict(set), [defaultdict(Counter), defaultdict(Counter)]
    for i, text, y in rows:
        owners = ["all"] + ([y] if y is not None and zlib.crc32(str(i).encode()) % 3 != 1 else [])
        for word in text.split():
            padded = "\0" * toxicity.ORDER + word + "\1"
            for at in range(toxicity.ORDER, len(padded)):
                for n in range(1, toxicity.ORDER + 1):
                    gram = padded[at - n + 1:at + 1]
                    for owner in owners:
                        kinds[owner, n, gram].add(padded[at - n:at + 1])
                    if n == toxicity.ORDER and len(owners) > 1:
                        counts[y][n][gram] += 1
    preceded = defaultdict(Counter)
    for (owner, n, gram), longer in kinds.items():
        if owner == "all":
            preceded[n][gram] = len(longer)
        elif n < toxicity.ORDER:
            counts[owner][n][gram] = len(longer)
    return counts, preceded


ROWS = [(i, t, y) for i, (t, y) in enumerate([("you idiot idiots", 1), ("a nice idea", 0), ("idle moron", 1), ("more news", 0),
                                              ("the moron news", 1), ("a more idle idea", 0)] * 8)]


# The second corpus has n-grams that no labelled text has, in contexts that labelled texts have.
@pytest.mark.parametrize("others", [["unlabelled zebras"], ["idzx idqq monk mokk", "thz nezz icy", "unlabelled zebras"]])
def test_model_equals_plain_kneser_ney(spark, others):
    rows = ROWS + [(1000 + i, t, None) for i, t in enumerate(others)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    trained = toxicity.train(frame.drop("toxic"), frame.select("doc_id", "toxic"))
    counts, preceded = plain_counts(rows)
    words = ["idiot", "idea", "moron", "more", "zebra", "x", "idiotic", "monk", "idzx"]
    expected = [plain_probability(counts, preceded, w, 1) - plain_probability(counts, preceded, w, 0) for w in words]
    assert trained.model.ratios(words) == pytest.approx(expected, rel=1e-4, abs=1e-4)


def test_toxicity_of_odd_rows(spark, labels, corpus):
    frame = docs(spark, [(1, None), (2, ""), (3, "!!! 。"), (None, "text"), (4, "you idiot " * 20000), (4, "calm words")])
    model = toxicity.train(corpus, labels.unionByName(labels))
    scored = {(r.doc_id, r.text): r.score_ for r in toxicity.with_scores(frame, model, "score_").collect()}
    assert len(scored) == 6 and scored[1, None] == scored[2, ""] == scored[3, "!!! 。"] < 0.5
    assert toxicity.with_scores(frame.limit(0), model).count() == 0
    bare = toxicity.toxicity(frame, labels.where("toxic = 1").limit(3))
    assert {r.score for r in bare.collect()} == {1.0}
    assert {r.score for r in toxicity.toxicity(frame, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(frame.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(frame, labels.limit(0))
    assert kept.columns == frame.columns and kept.count() == 6


def test_scoring_looks_up_each_letter_and_token_once(spark, monkeypatch):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.drop("toxic"), frame.select("doc_id", "toxic")).model
    odd = ["", " ", "\t\n_", "you,idiot", "An IDIOT\u3000moron.\x0bmore", "\u0130D\u0130OT idiot\u03a3\u03a3 \u03a3 a\u03a3'b", "no\xa0break _x_y1",
           "moron" * 3000, "idle\x1cidea\x85news", " \u4e2d\u6587\u3002\u5b57 \U0001d400\u0301x "]
    texts = [*odd, *["the moron, a nice idea: idle idiots!"] * 500, None]
    # Word by word, with nothing remembered.
    apart = {text: [model.ratios([word])[0] for word in toxicity.words_of(text or "")] for text in set(texts)}
    expected = np.array([toxicity.features(np.array(apart[text])) for text in texts])
    looked, scanned, look = [], [], toxicity.Lookup.__call__
    monkeypatch.setattr(toxicity.Lookup, "__call__", lambda self, wanted: looked.append(len(wanted)) or look(self, wanted))

    class Scan:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            scanned.append(len(text))
            return self.pattern.findall(text)

    for name in ("_WORD", "_IN_LINES"):
        if hasattr(toxicity, name):
            monkeypatch.setattr(toxicity, name, Scan(getattr(toxicity, name)))
    # Few words together: most letters come again in later groups.
    monkeypatch.setattr(toxicity, "_TOGETHER", 4)
    arrow = pa.schema([(f"x{i}", pa.float64()) for i in range(3)])
    run = toxicity._apply(SimpleNamespace(value=model), arrow, 0, lambda x: [pa.array(np.ascontiguousarray(c)) for c in x.T])
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    done = pa.Table.from_batches(run(iter([batch, batch])))
    found = np.stack([column.to_numpy() for column in done.columns], axis=1)
    assert np.array_equal(found, np.concatenate([expected, expected]))
    # The many texts hold 36 characters each, the odd ones 15,100 together.
    assert sum(scanned) < 2 * 16_000
    assert np.array_equal(toxicity._Scorer(model)(pa.array(texts[:-1], pa.large_string())), expected[:-1])
    looked.clear()
    # Letters after known ones are looked up in one table, not in two for each of six orders.
    scorer, words = toxicity._Scorer(model), ["moron", "idiots", "idle", "nice"]
    for _ in range(3):
        scorer.known.clear()
        scorer(pa.array(words))
    assert sum(looked) < (12 + 3 * 2) * sum(len(word) + 1 for word in words)


def test_shared_counts_of_repeated_words(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 8)  # forgets, and reports again
    texts = ["a nice idea", "A,nice;idea", "a\x0bnice idea_", None, "", "idle idiots more moron news you the idea " * 3]
    for each in texts, texts * 50:
        frame = spark.createDataFrame([(t,) for t in each], "text string").coalesce(1)
        rows = {(r.context, r.gram): r.n for r in toxicity._preceded(frame).collect()}
        _, preceded = plain_counts([(1, " ".join(toxicity.words_of(t or "")), None) for t in each])
        assert sorted(rows.values()) == sorted(n for order in (1, 2, 3) for n in preceded[order].values())


PLAIN = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def plain_spans(text):
    found = [(m.start(), order, m.end(), kind) for order, (kind, pattern, group, least) in enumerate(PLAIN)
             for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


SECRETS = [(1, None), (2, ""), (3, "é Password='abcdef' TOKEN=12345 token=123456 apiKey:x.y-z_+/="), (4, "AKIA" + "A" * 16 + " AKIA" + "B" * 15),
           (5, "0123456789abcdef" * 3 + " ſecret=abcdefg paſſword=abcdefg"), (6, "x" * 100000 + " secret: 日 secret:abcdefgh"),
           (7, "secret = token=abcdefghij password=password=abcdef"), (None, "api_key=\"abcdefg\""), (7, "AKIA" + "0" * 30 + "ab" * 12)]


def test_base_spans_match_the_patterns(spark, corpus):
    for frame in (docs(spark, SECRETS), corpus):
        texts = Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())
        found = Counter()
        rows = credentials.find_secrets(frame).collect()
        for (i, text), n in texts.items():
            spans = plain_spans(text)
            found[(i, *(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")),
                   hashlib.sha256(",".join(spans).encode()).hexdigest())] += n
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == found
        assert all(set(filter(None, r.spans.split(","))) >= set() for r in rows)
    assert credentials.find_secrets(docs(spark, SECRETS).limit(0)).count() == 0


def test_formats_are_learnt_and_added(spark):
    draw = random.Random(3)

    def key():
        return "sk_live_" + "".join(draw.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(24))
    rows = [(i, f"words before secret={key()} and after it some more words") for i in range(60)]
    loose = key()
    rows += [(100, f"nothing but ordinary words, then {loose} in the open"), (101, "an-ordinary-but-long-name-of-2-things and words"),
             (102, "word " * 5000)]
    rows += [(200 + i, " ".join(draw.choice(["plain", "prose", "about", "some", "things", "live", "skis"]) for _ in range(80))) for i in range(200)]
    frame = docs(spark, rows)
    found = {r.doc_id: r.spans for r in credentials.find_secrets(frame).collect()}
    start = rows[60][1].index(loose)
    assert found[100] == f"format:{start}:{start + len(loose)}" and found[101] == found[102] == ""
    clean = credentials.redact(frame)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == frame.columns and texts[100] == "nothing but ordinary words, then [SECRET] in the open"
    assert texts[102] == rows[62][1] and texts[0] == "words before [SECRET] and after it some more words"


def test_short_lettered_and_dotted_formats_are_added(spark):
    draw = random.Random(5)

    def letters():
        return "".join(draw.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(12))

    def dotted():
        return ".".join("".join(draw.choice("bcdfghjkmnpqvwxz") for _ in range(4)) for _ in range(3))
    rows = [(i, "words before password=" + (letters, dotted)[i % 2]() + " and after it some more words") for i in range(120)]
    bare, other, third = letters(), dotted(), letters()
    rows += [(500, f"words then {bare} in the open"), (501, f"é words, {other} and the sentence ends with {third}."),
             (502, f"{bare}.{'0a1b2c3d' * 4}"), (503, "an ordinary sentence of words. It ends here.")]
    rows += [(600 + i, " ".join(draw.choice(["plain", "prose", "about", "something", "ordinary", "sentence", "words"]) for _ in range(200)))
             for i in range(200)]
    frame = docs(spark, rows)
    found = {r.doc_id: r.spans for r in credentials.find_secrets(frame).collect()}
    text = dict(rows)

    def spot(i, value):
        return f"format:{text[i].index(value)}:{text[i].index(value) + len(value)}"
    assert found[500] == spot(500, bare) and found[503] == ""
    assert found[501] == f"{spot(501, other)},{spot(501, third)}"
    # A dot is a letter of these credentials, but none of them has thirteen characters.
    assert found[502] == "format:0:12,hex:13:45"
    assert not any(found[600 + i] for i in range(200))
    clean = {r.doc_id: r.text for r in credentials.redact(frame).collect()}
    assert clean[500] == "words then [SECRET] in the open" and clean[502] == "[SECRET].[SECRET]"


FORMATS = {"hex": (r"[0-9a-f]{32}", "0123456789abcdef", "%32"), "access": (r"AKIA[A-Z0-9]{16}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA%16"),
           "dotted": (r"[a-z0-9]{8}\.[a-z0-9]{6}\.[a-z0-9]{10}", "abcdefghijklmnopqrstuvwxyz0123456789", "%8.%6.%10")}


def drawn(draw, kind):
    _, letters, form = FORMATS[kind]
    return re.sub(r"%(\d+)", lambda m: "".join(draw.choice(letters) for _ in range(int(m[1]))), form).encode()


@pytest.mark.parametrize("kind", FORMATS)
def test_automaton_keeps_length_and_fixed_places(kind):
    draw = random.Random(1)
    automaton = credentials.infer([drawn(draw, kind) for _ in range(400)])
    size = len(drawn(draw, kind))
    # One state per place at least, and not one per word.
    assert size < len(automaton.moves) < 3 * size
    for _ in range(50):
        word = drawn(draw, kind)
        for other in (word[:-1], word + word[-1:], word[::-1] if kind != "hex" else word.upper() + b"F", word + word):
            assert automaton.log_likelihood(other) < automaton.log_likelihood(word) - 2


def test_generated_words_follow_the_format():
    """Words drawn from the inferred automaton itself, without the share kept for the unseen."""
    draw = random.Random(2)
    for kind, (pattern, _, _) in FORMATS.items():
        automaton, good = credentials.infer([drawn(draw, kind) for _ in range(600)]), 0
        for _ in range(200):
            state, word = 0, b""
            while len(word) < 100:
                symbols = list(automaton.symbols[state].items())
                pick = draw.choices(range(len(symbols) + 1), [np.exp(p) for _, p in symbols] + [max(0, np.exp(automaton.ends[state]) - 0.01)])[0]
                if pick == len(symbols):
                    break
                word += bytes([symbols[pick][0]])
                state = automaton.moves[state][symbols[pick][0]]
            good += bool(re.fullmatch(pattern.encode(), word))
        assert good > 180, kind


def test_long_and_few_words():
    loop = credentials.infer([b"ab" * n for n in range(500, 3000, 100)])
    assert len(loop.moves) < 300 and loop.log_likelihood(b"ab" * 500) > loop.log_likelihood(b"ba" * 500)
    assert len(credentials.infer([b"secret1"]).moves) == 1 and len(credentials.infer([]).moves) == 1


def test_few_credentials_still_give_a_format(spark):
    draw = random.Random(7)
    plain = " ".join(draw.choice(["plain", "prose", "about", "something", "ordinary", "sentence", "words"]) for _ in range(3000))
    for n in (1, 3, 7):
        keys = ["tok-" + drawn(draw, "hex").decode()[:20] for _ in range(n)]
        bare = keys[0] if n == 1 else "tok-" + drawn(draw, "hex").decode()[:20]
        rows = [(i, f"password={key} {plain}") for i, key in enumerate(keys)] + [(100, f"see {bare} there"), (101, plain)]
        found = {r.doc_id: r.spans for r in credentials.find_secrets(docs(spark, rows)).collect()}
        assert found[100] == f"format:4:{4 + len(bare)}" and found[101] == ""


def test_planted_keys_among_given_texts(spark, corpus):
    """Bare keys of a format that only labelled credentials show; texts without stay untouched."""
    draw = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key():
        return "tk_" + "".join(draw.choice(letters) for _ in range(28))
    rows, bare = [], {}
    for n, r in enumerate(corpus.select("doc_id", "text").orderBy("doc_id").collect()):
        text = r.text
        if n % 5 == 0:
            text = f"{text} token={key()} end"
        elif n % 5 == 1:
            bare[r.doc_id] = key()
            text = f"{text} {bare[r.doc_id]} end"
        rows.append((r.doc_id, text))
    found = {r.doc_id: r.spans for r in credentials.find_secrets(docs(spark, rows)).collect()}
    hits = sum(f"format:{len(t) - 4 - len(bare[i])}:{len(t) - 4}" in found[i] for i, t in rows if i in bare)
    wrong = sum("format" in found[i] for i, _ in rows if i not in bare)
    assert hits >= 0.9 * len(bare) and wrong <= 0.002 * len(rows), (hits, len(bare), wrong)


def test_chunk_ends_resist_shifts_and_are_local():
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcdefghié") for _ in range(draw.randint(2, 9))) for _ in range(2000)).encode()
    ends = chunks.chunk_ends(np.frombuffer(text, np.uint8))
    assert ends[-1] == len(text) and (np.diff(ends) > 0).all() and np.diff(ends).max() <= chunks.LONGEST
    moved = chunks.chunk_ends(np.frombuffer(b"some new words " + text, np.uint8)) - 15
    assert len(set(ends) - set(moved)) <= 4
    for a, b in zip([0, *ends], ends):
        text[a:b].decode()
    hashes = chunks.gear_hashes(np.frombuffer(text, np.uint8))
    rolled = 0
    for byte, value in zip(text, hashes):
        rolled = ((rolled << 1) + int(chunks.GEAR[byte])) & 0xFFFF
        assert rolled == value
    periodic = chunks.chunk_ends(np.frombuffer(b"ab" * 5000, np.uint8))
    assert np.diff(periodic).max() < 3 * chunks.REACH and periodic[-1] == 10000


def plain_chunks(text):
    """Chunk ends byte by byte."""
    data, size, reach = text.encode(), len(text.encode()), chunks.REACH
    if not size:
        return []
    hashes, rolled = [], 0
    for byte in data:
        rolled = ((rolled << 1) + int(chunks.GEAR[byte])) & 0xFFFF
        hashes.append(rolled)
    ends, last = [], -reach
    for at in range(size if size > reach + 1 else 0):
        before, after = hashes[max(0, at - reach):at], hashes[at + 1:at + 1 + reach]
        if all(hashes[at] >= h for h in before + after):
            if all(hashes[at] > h for h in before) or at + 1 - last >= reach:
                ends.append(at + 1)
                last = at + 1
    edges = [0, *[e for e in ends if e < size], size]
    cut = [at for a, b in zip(edges, edges[1:]) for at in (range(a, b, chunks.LONGEST) if max(np.diff(edges)) > chunks.LONGEST else [a])]
    found = set()
    for end in [*cut[1:], size]:
        while end < size and data[end] & 0xC0 == 0x80:
            end += 1
        found.add(end)
    return sorted(found)


def plain_spans_of(rows):
    """Spans of repeats by dictionaries: (id, start, end, words, chunks, first id, kept words)."""
    parts, first, count = [], {}, Counter()
    for row, (i, text) in enumerate(rows):
        data, at, seen = (text or "").encode(), 0, set()
        for end in plain_chunks(text or ""):
            chunk = data[at:end]
            heads = sum(not bytes([b]).isspace() and (p == 0 or bytes([data[p - 1]]).isspace()) for p, b in enumerate(data[at:end], at))
            parts.append((row, i, chunk, len(data[:at].decode()), len(data[:end].decode()), heads, chunk in seen))
            seen.add(chunk)
            count[chunk] += 1
            if i is not None and (first.get(chunk) is None or i < first[chunk]):
                first[chunk] = i
            at = end
    spans, open_ = [], None
    for row, i, chunk, a, b, words, again in parts:
        if count[chunk] < 2:
            continue
        if open_ is None or open_[0] != row or open_[3] != a:
            open_ = [row, i, a, b, 0, 0, [], 0]
            spans.append(open_)
        open_[3] = b
        open_[4] += words
        open_[5] += 1
        open_[6].append(first.get(chunk))
        open_[7] += words * (first.get(chunk) == i and not again)
    return Counter((i, a, b, words, n, min([f for f in firsts if f is not None], default=None), kept)
                   for _, i, a, b, words, n, firsts, kept in spans if words >= chunks.MIN_WORDS)


def test_spans_equal_a_plain_chunker(spark, corpus):
    given = [(r.doc_id, r.text) for r in corpus.where("length(text) < 6000").orderBy("doc_id").limit(250).collect()]
    odd = [(None, given[0][1]), (5000, "same word " * 90), (5001, "x" + "same word " * 80), (5001, given[3][1]), (5002, "é" * 700), (5003, None)]
    for rows in (given + odd, odd):
        found = chunks.repeated_spans(docs(spark, rows).repartition(3)).collect()
        assert Counter((r.doc_id, r.start, r.end, r.words, r.chunks, r.first_doc_id, r.kept_words) for r in found) == plain_spans_of(rows)


def test_periodic_passages_are_found(spark):
    draw = random.Random(9)

    def noise(n):
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n))
    rows = []
    for pair in range(200):
        unit = "".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 9))) + " "
        if pair % 2:
            unit += "".join(draw.choice("klmnopq") for _ in range(draw.randint(1, 9))) + " "
        passage = unit * (60 // (1 + pair % 2))
        rows += [(2 * pair + copy, f"{noise(draw.randint(100, 400))} {passage}{noise(draw.randint(100, 400))}") for copy in (0, 1)]
    best = Counter()
    for r in chunks.repeated_spans(docs(spark, rows)).collect():
        best[r.doc_id] = max(best[r.doc_id], r.words)
    assert sum(best[2 * p] >= 20 and best[2 * p + 1] >= 20 for p in range(200)) >= 198


def test_repeats_are_cut_row_by_row(spark):
    draw = random.Random(12)
    texts = [" ".join("".join(draw.choice("abcdefghié") for _ in range(draw.randint(2, 9))) for _ in range(300)) for _ in range(8)]
    shared = " ".join(texts[0].split()[:120])
    rows = [(1, f"{texts[1]} {shared} {texts[2]}"), (None, f"{texts[3]} {shared} {texts[4]}"), (7, f"{texts[5]} {shared} {texts[6]}"), (7, texts[7])]
    after = Counter((r.doc_id, len(r.text)) for r in chunks.drop_repeats(docs(spark, rows)).collect())
    sizes = {(i, t): len(t) for i, t in rows}
    assert after[1, len(rows[0][1])] == 1 and after[7, len(texts[7])] == 1
    for i, t in rows[1:3]:
        (left,) = [n for (j, n) in after if j == i and n != len(texts[7])]
        assert 0.7 * len(shared) < sizes[i, t] - left <= len(shared) + 6


def test_repeated_passages(spark, corpus):
    draw = random.Random(4)
    texts = [r.text for r in corpus.where("length(text) > 3000").orderBy("doc_id").collect()]

    def filler(n):
        words = draw.choice(texts).split()
        draw.shuffle(words)
        return " ".join(words[:n])
    rows, planted = [], {}
    for p in range(40):
        passage = filler(60)
        for copy in range(3):
            rows.append((p * 10 + copy, f"{filler(80)} {passage} {filler(70)}"))
            planted[p * 10 + copy] = (p * 10, passage)
    rows += [(1000 + i, filler(150)) for i in range(60)] + [(2000, None), (2001, ""), (None, "tiny"), (2002, "same " * 30000)]
    frame = docs(spark, rows)
    texts = {i: t for i, t in rows}
    spans = defaultdict(list)
    for r in chunks.repeated_spans(frame).collect():
        spans[r.doc_id].append(r)
    assert set(spans) - {2002} == set(planted)
    for i, (first, passage) in planted.items():
        (span,) = spans[i]
        assert span.first_doc_id == first and texts[i][span.start:span.end] in texts[i]
        inside = texts[i].index(passage)
        # Chunks reach over a passage's edge only where both neighbours agree by chance.
        assert inside - 3 <= span.start and span.end <= inside + len(passage) + 3
        # A chunk at the edge may be shared by the later copies alone.
        assert (span.kept_words == span.words) == (i == first) and (not span.repeats) == (i == first)
        assert i == first or span.words - span.kept_words >= 20
    kept = chunks.drop_repeats(frame)
    after = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == frame.columns and len(after) == len(texts)
    for i, t in texts.items():
        if i in planted and i != planted[i][0]:
            cut = {at for r in spans[i][0].repeats for at in range(r.start, r.end)}
            assert after[i] == "".join(c for at, c in enumerate(t) if at not in cut)
        elif i != 2002:
            assert after[i] == t
    assert chunks.repeated_spans(frame.limit(0)).count() == 0


def test_pipeline_stages_match_brute_force(spark, corpus, labels):
    frame, seen = corpus, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name != "packing":
            assert out.schema.names == corpus.schema.names
        before, frame = frame, out.cache()
        seen.append((name, before.collect(), frame.collect()))
    (_, given, clean), (_, _, single), (_, _, apart), (_, _, redacted), (_, last, pieces) = seen
    model = toxicity.train(corpus, labels)
    scores = {r.doc_id: r.s for r in toxicity.with_scores(corpus, model, "s").collect()}
    assert sorted(clean) == sorted(r for r in given if scores[r.doc_id] < 0.7)
    by_text = {}
    for r in sorted(clean):
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(single) == sorted(by_text.values())
    rows = sorted(single)
    label = components([plain_print(r.text or "") for r in rows])
    assert sorted(apart) == [r for n, r in enumerate(rows) if label[n] == n]
    texts = {r.doc_id: r for r in apart}
    assert len(redacted) == len(apart)
    for r in redacted:
        old = texts[r.doc_id]
        assert (r.text == old.text) == (not plain_spans(old.text)) and not plain_spans(r.text.replace("[SECRET]", " "))
        assert r.n_chars == (old.n_chars if r.text == old.text else len(r.text))
        assert (r.lang, r.source) == (old.lang, old.source)
    encoder = packing.WordEncoder(open(packing.vocabulary_file("word_bpe_49k.json"), "rb").read())
    counts = {r.doc_id: len(encoder.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in last}
    held = Counter()
    for p in pieces:
        held[p.doc_id] += p.length
    assert held == counts
    direct = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()}
    assert {(d, t) for d, _, _, _, t in direct} == set(counts.items())


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "a text", None, None, 6), (3, "x " * 200000, "en", "s", 1)]
    for n, part in enumerate((rows, [])):
        base = f"{tmp_path}/{n}"
        spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([(1, 1, None), (None, 0, 1)][:2 * len(part)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        found = corpus_pipeline.run(spark, base).collect()
        assert {r.doc_id for r in found} == ({1, 3, None} if part else set())


def test_simhash_uses_all_of_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    assert simhash.fingerprint(long.encode()) == plain_print(long)
