import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import chat_format, decontaminate, lattice, lm_score, packing, pii
from tests.llm.conftest import texts


def _contaminated(rows, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = word(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = word(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k:k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= {str(v) for v in windows[x] if v is not None}
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def _found(df):
    return sorted(((r.doc_id, r.n_words, sum(s["words"] for s in r.spans), tuple(r["items"])) for r in df.collect()), key=str)


def test_decontamination(edge, none, benchmark, monkeypatch):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = _contaminated(texts(), items)
    assert _found(decontaminate.matches(edge, benchmark)) == want
    assert decontaminate.matches(none, benchmark).count() == 0
    assert _found(decontaminate.matches(edge, benchmark.limit(0))) == _contaminated(texts(), [])
    clean = decontaminate.decontaminated(edge, benchmark)
    assert clean.columns == edge.columns
    assert clean.count() == sum(1 for w in want if not w[2])
    # test items in several blocks: the same rows
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    assert _found(decontaminate.matches(edge, benchmark)) == want
    assert decontaminate.decontaminated(edge, benchmark).count() == clean.count()


def test_decontamination_has_the_same_rows_in_several_blocks(spark, edge, benchmark, monkeypatch):
    more = spark.createDataFrame([(None, "nothing of it"), (None, "see one two"), (None, "one two one")], "doc_id bigint, text string")
    docs = edge.select("doc_id", "text").unionByName(more)
    rows = lambda: sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"], r.longest) for r in decontaminate.matches(docs, benchmark).collect()), key=str)
    want = rows()
    assert len(want) == len(texts()) + 3
    for words in (3, 12):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        assert rows() == want


def test_longest_match_and_its_place(spark):
    docs = spark.createDataFrame([(1, "p q " + " ".join(f"t{k}" for k in range(30)) + " z")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "u " + " ".join(f"t{k}" for k in range(5, 25)) + " v")], "item_id bigint, text string")
    r = decontaminate.matches(docs, items).first()
    assert r.longest == 20 and [tuple(s) for s in r.spans] == [(7, 20)]


def _pieces(docs):
    return packing.pack(docs, packing.default_tokenizer()).toPandas()


def test_packing_round_trip(edge, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = _pieces(edge)
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in texts()}
    assert got.length.sum() == sum(len(ids[i]) for i, _ in texts())
    for r in got[got.doc_id.notna()].itertuples():
        part = ids[int(r.doc_id)][r.start:r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[int(r.doc_id)])
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= packing.WINDOW
    size = got.groupby("sequence_id").length.sum()
    padding = (packing.WINDOW - size[(size & (size - 1)) != 0]).sum()
    assert padding <= 0.02 * size.sum()
    assert len(_pieces(none)) == 0


def test_words_are_tokenised_as_whole_texts_are():
    import pyarrow as pa
    from litspark.llm.common import utf8
    odd = ["A. b., x.. don't. a's. é. 9. 9.9.", "a<|endoftext|>b <|ENDOFTEXT|>.", "ΑΣ Σ ǅ İstanbul", "é É. ́x", "\x01 a\x01b", "\x1cq w\x85z", "", " ", "I'LL 1234 abc123,"]
    words = packing.WordTokenizer(packing.default_tokenizer())
    ids, begin = words.encode(*utf8(pa.array(odd)))
    for k, t in enumerate(odd):
        assert ids[begin[k]:begin[k + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids + [2], t


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        places = np.unique(rng.integers(1, 120, 25))
        cost = rng.integers(0, 6, len(places))
        best, back = packing.best_cuts(places, cost, 30)
        at, pen = [0, *places.tolist()], [0, *cost.tolist()]
        want = [0] + [math.inf] * len(places)
        for j in range(1, len(at)):
            want[j] = min((want[i] + 30 - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 30), default=math.inf)
            if want[j] == math.inf:
                break
        else:
            assert best == want and all(at[j] - at[back[j]] <= 30 for j in range(1, len(at)))


@pytest.mark.parametrize("last", [True, False])
def test_windows_end_at_boundaries_where_there_are_any(last):
    rng = np.random.default_rng(4)
    stop = np.array([False, False, False, True])
    ids = np.where(rng.random(200_000) < 0.02, 3, 1).astype(np.uint32)
    ids[60_000:75_000] = 1  # a stretch of several windows without a sentence
    ends = np.array([1, 700, 9000, 90_000, 90_001, 199_000])
    ids[ends - 1] = 2
    cuts = packing.cut_windows(ids, ends, stop, last)
    natural = set(ends.tolist()) | set((np.flatnonzero(ids == 3) + 1).tolist())
    sizes = np.diff([0, *cuts])
    assert sizes.min() > 0 and sizes.max() <= packing.WINDOW
    left = len(ids) - [c for c in cuts if c in natural][-1]
    assert left < packing.WINDOW  # behind it, windows of powers of two
    blind = [c for c in cuts if c not in natural and c <= len(ids) - left]
    assert all(60_000 < c < 75_000 for c in blind) and 3 <= len(blind) <= 5
    full = sizes[:-12]
    assert (packing.WINDOW - full).sum() < 0.01 * full.sum()


def _base(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 8 <= len(d) <= 15 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = [None, "", "a@b.c_x@y.z", "a@b..c@d.e", "1.2.3.4.5.6.7.8", "é 1.2.3.256 01.002.3.255 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
       "+1 (743) 555-3824.", "+1((((+12345678 9", "𝄞a@b.co 𝄞 1.1.1.1", "--@--.--.--", "+12345678901234567", "1 a " * 300, "é1.1.1.1 " * 300, "9 " * 500]


def test_pii_base_spans(spark, tmp_path):
    for name, rows in (("some", list(enumerate(PII)) + [(0, None)]), ("none", [])):
        spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit("x")).withColumn("base", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = pii.query(spark, f"{tmp_path}/some").collect()
    assert len(got) == len(PII) + 1
    for r in got:
        want = _base(PII[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), PII[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(filter(None, r.spans.split(",")))
    assert pii.query(spark, f"{tmp_path}/none").count() == 0


def test_pii_reads_the_whole_part_of_an_ip(spark):
    cases = ["20240101.1.2.3", "10001.2.3.4", "1.2.3.10255", "1.2.3.0000000255", "000.00.0.1", "1.2.3.1000"]
    got = pii.base_spans(spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")).collect()
    assert {cases[r.doc_id]: len(r.ip) for r in got} == {c: sum(x.startswith("ip") for x in _base(c)) for c in cases}


def test_pii_learns_a_context(spark):
    rows = [(k, f"word{k} please call phone number +1 (555) 555-01{k:02d} today ok{k}") for k in range(12)]
    rows += [(50, "x please call phone number 555 555 0199 today y"), (51, "the year number 555 555 0198 was fine"), (52, "no number at all")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in found[50].added] == [(3, 27, 39)]
    assert not found[51].added and not found[52].added and all(not found[k].added for k in range(12))


def _added(spark, rows):
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    return {i: sorted(t[s.start:s.end] for s in found[i].added) for i, t in rows}


def test_pii_marks_what_punctuation_and_neighbours_enclose(spark):
    rows = [(k, f"word{k} please call phone number +1 (555) 555-01{k:02d} today ok{k}") for k in range(48)]
    cases = {50: ("ring phone number 555 555 0199, or not", "555 555 0199"), 51: ("the phone number (030 1234567), ok", "030 1234567"),
             52: ("his phone number: 030 1234569; bye", None), 53: ("phone number 555-555-0197!", "555-555-0197"),
             54: ("see 12 phone number 030 1234568 030 7654321 x", "030 1234568 030 7654321"), 55: ("phone number " + "5" * 150, None)}
    got = _added(spark, rows + [(i, t) for i, (t, _) in cases.items()])
    for i, (_, want) in cases.items():
        assert got[i] == ([want] if want and len(re.sub("[^0-9]", "", want)) <= 15 else []), cases[i]


def test_pii_learns_from_what_it_has_learned(spark):
    """Numbers found in one context teach the next one, as far as it goes."""
    rows = [(k, f"w{k} please call phone number +1 (555) 555-01{k:02d} today") for k in range(48)]
    for k in range(12):
        rows += [(100 + k, f"a{k} call phone number 551 555 03{k:02d} today"), (200 + k, f"b{k} fax office line 551 555 03{k:02d} soon{k}")]
    for k in range(3):
        rows += [(300 + k, f"c{k} fax office line 552 555 04{k:02d} then{k}"), (400 + k, f"d{k} main support desk 552 555 04{k:02d} or{k}")]
    rows.append((500, "my order number 553 555 0500 came"))
    got = _added(spark, rows)
    assert all(got[i] for i, _ in rows if 100 <= i < 500) and not got[500]


def test_lattice_against_a_recursion():
    pieces, first = lattice.vocabulary(lm_score.default_vocabulary())
    logp, number = np.log(first), {n: i for i, n in enumerate(pieces.names)}

    def total(w):
        s, a = lattice.START + w, [0.0]
        for j in range(1, len(s) + 1):
            t = []
            for i in range(max(0, j - pieces.longest), j):
                if s[i:j] in number:
                    t.append(a[i] + logp[number[s[i:j]]])
                elif j - i == 1:
                    t.append(a[i] + sum(logp[pieces.bytes_at + b] for b in s[i:j].encode()))
            a.append(max(t) + math.log(sum(math.exp(x - max(t)) for x in t)))
        return a[-1]

    words = ["the", "thanedble", "a", "xyz123", "日本語", "ñe€𝄞", "a" * 300, "é,"]
    assert np.allclose(lattice.log_probabilities(words, pieces, logp), [total(w) for w in words], rtol=1e-5)
    counts = lattice.expected_counts(["the", "x𝄞"], np.array([2.0, 3.0]), pieces, logp)
    assert sum(len(n) * c for n, c in zip(pieces.names, counts)) == pytest.approx(2 * 4 + 3 * 2, rel=1e-4)
    assert counts[pieces.bytes_at:].sum() == pytest.approx(3 * 4, rel=1e-4)


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_lm_base_score(edge, none, head, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", head)
    held = F.col("doc_id") == 11
    got = lm_score.score(edge, ~F.coalesce(held, F.lit(False)), lm_score.default_vocabulary()).collect()
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]) for i, t in texts()]
    c = Counter(w for i, ws in tokens if i != 11 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in tokens), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)
    if head == 5:
        assert lm_score.score(none, F.lit(True), lm_score.default_vocabulary()).count() == 0


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "eve", "é"), (1, 3, "eve", "é"), (2, None, None, "x"),
            (2, 1, " ", "y"), (3, 0, "system", "alone"), (None, 0, "ann", "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("start", F.lit(1)).withColumn("part", F.lit("p"))
    got = chat_format.rotated(turns).orderBy("conv_id", "perspective", "position").collect()
    whole = {}
    for r in got:
        text, masked = whole.get((r.conv_id, r.perspective), ("", ""))
        assert r.start == len(text)
        text += r.segment
        if r.mask_start is not None:
            masked += text[r.mask_start:r.mask_start + r.mask_length]
        whole[r.conv_id, r.perspective] = text, masked
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "eve"), (2, "unknown"), (None, "ann")}
    end = "<|im_end|>\n"
    assert whole[1, "bob"][0] == (f"<|im_start|>system\nbe kind{end}<|im_start|>user name=ann\nhi{end}<|im_start|>assistant\n{end}"
                                  f"<|im_start|>user name=eve\né{end}<|im_start|>user name=eve\né{end}")
    assert whole[1, "eve"][1] == f"é{end}é{end}" and whole[1, "bob"][1] == end and whole[2, "unknown"][1] == f"x{end}y{end}"
    assert chat_format.rotated(turns.limit(0)).count() == 0
