"""Queries over small tables of their own, against brute force: no document, span or candidate is left out."""

import difflib
import hashlib
import random
import re
from collections import Counter

from spanloom.operators import similarity as S
from spanloom.operators import synth as Y
from spanloom.plans import inputs, queries_corpus, queries_more, queries_review


def tables(spark, folder, documents, **others):
    """Writes the tables of a fixture; documents are (doc_id, text)."""
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    kinds = {"benchmark": "item_id long, text string", "conversations": "conv_id long, turn int, role string, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame(others.get(name, []), kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def gold(spark, d):
    out = {}
    for r in inputs.gold_spans(spark, d).orderBy("doc_id", "start", "end", "label").collect():
        out.setdefault(r.doc_id, []).append((r.start, r.end, r.label))
    return out


def test_paraphrases_of_whole_documents(spark, tmp_path):
    words = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti vu za".split() for b in "ben dor fil gam hul jin".split()]
    documents = [(i, " ".join(words[(i * 7 + j * (i + 1)) % 60] for j in range(4 + 4 * i))) for i in range(40)] + [(50, "Short one"), (51, "Lone")]
    documents += [(60, documents[9][1].upper()), (61, documents[5][1].replace(" ", " the ", 30))]
    d = tables(spark, tmp_path, documents, benchmark=[(0, "So: " + documents[3][1])])
    spans, want, seen = gold(spark, d), {}, set()
    for i, t in documents:
        text, source = "So: " + t, hashlib.sha256(" ".join(t.lower().split()).encode()).hexdigest()[:16]
        placed = Y.place_all(text, [(t[s:e], label) for s, e, label in spans.get(i, [])])
        bad = placed is None or not 10 <= len(text) <= 500 or any(text[x["start"] : x["end"]].lower() == "the" for x in placed)
        if not bad and i != 3 and source not in seen:
            seen.add(source)
            want[i] = {(x["start"], x["end"]) for x in placed} or {(None, None)}
    got = {}
    for r in queries_review.accepted_paraphrases(spark, d).collect():
        got.setdefault(r["rank"], set()).add((r.start, r.end))
    assert got == want
    assert max(len(x) for x in want.values()) > 2 and {len(t) > 500 for _, t in documents} == {True, False}


def norm(s):
    return " ".join(s.lower().split())


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlu" * 3 + "cmfwypvbgkjqxz.,") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def changed(rnd, text, n):
    out = list(text)
    for _ in range(n):
        at = rnd.randrange(len(out))
        out[at : at + rnd.randrange(3)] = rnd.choice(["", "e", "zq", " "])
    return "".join(out)


def test_bounds_of_the_ratio_hold():
    rnd, kept, cut = random.Random(4), 0, 0
    for _ in range(300):
        a = prose(rnd, rnd.randrange(20, 200))
        b = norm(changed(rnd, a, rnd.randrange(1, len(a) // 6))) if rnd.random() < 0.7 else prose(rnd, rnd.randrange(20, 200))
        covered = sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        most = min(S.common_length(a, b), *((S.most_matched(a, b), S.covered(a, b)) if len(b) >= S.LONG else (len(a),)))
        assert covered <= most
        cut, kept = cut + (most < 0.35 * (len(a) + len(b))), kept + (covered >= 0.35 * (len(a) + len(b)))
    assert cut > 30 and kept > 30


def test_fold_pools_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    texts = [prose(rnd, 80 + 5 * i) for i in range(14)]
    texts += [changed(rnd, t, len(t) // 200) for t in texts[:6]] + [changed(rnd, t, len(t) // 3) for t in texts[:6]] + [texts[9], texts[10].upper(), "tiny text"]
    documents, turns = list(enumerate(texts)), [(0, 0, "user", texts[3]), (0, 1, "user", "A turn"), (1, 0, "user", texts[8])]
    got = {(r.fold, r.part): r.n for r in queries_more.fold_pools(spark, tables(spark, tmp_path, documents, conversations=turns)).collect()}
    want = Counter()
    for fold in range(5):
        val = [t for i, t in documents if i % 5 == fold]
        keys = {norm(t) for t in val}
        by_source = {norm(t) for t in texts} & keys
        like = lambda p: any(difflib.SequenceMatcher(None, norm(p), norm(v)).ratio() >= 0.7 for v in val)
        by_similarity = {norm(t) for i, t in documents if norm(t) not in by_source and like(f"{t} {i}")}
        want |= {(fold, "real"): len(texts) - len(val), (fold, "generated"): sum(t.lower() not in {v.lower().strip() for v in val} for *_, t in turns)}
        want |= {(fold, "paraphrase"): sum(norm(t) not in by_source | by_similarity for t in texts), (fold, "removed_by_source"): len(by_source), (fold, "removed_by_similarity"): len(by_similarity)}
    assert got == {k: n for k, n in want.items() if n}
    assert sum(n for (_, part), n in want.items() if part == "removed_by_similarity") > 5


def test_make_folds_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    texts = [prose(rnd, 60 + 6 * i) for i in range(15)]
    texts += [changed(rnd, texts[i], len(texts[i]) // 150) for i in (0, 3, 6, 9, 12)] + [texts[3].upper(), texts[4] + " "]
    documents, turns = list(enumerate(texts)), [(0, 0, "user", texts[3].upper()), (0, 1, "user", "A turn"), (1, 0, "user", texts[8])]
    got = {(r.fold, r.part): r.n for r in queries_more.make_folds(spark, tables(spark, tmp_path, documents, conversations=turns)).collect()}
    own = {}
    for i, t in documents:
        own.setdefault(norm(t), (i, t))
    real = sorted(own.values())
    para = [(norm(t), "Besides, " + t) for i, t in documents if i % 3 == 0]
    want = Counter()
    for fold in range(5):
        val = [t for k, (_, t) in enumerate(real) if k % 5 == fold]
        by_source = {s for s, _ in para if s in {norm(v) for v in val}}
        by_similarity = {s for s, t in para if s not in by_source and any(difflib.SequenceMatcher(None, norm(t), norm(v)).ratio() >= 0.7 for v in val)}
        want |= {(fold, "real"): len(real) - len(val), (fold, "validation"): len(val), (fold, "generated"): sum(t.lower().strip() not in {v.lower().strip() for v in val} for *_, t in turns)}
        want |= {(fold, "paraphrase"): sum(s not in by_source | by_similarity for s, _ in para), (fold, "removed_by_source"): len(by_source), (fold, "removed_by_similarity"): len(by_similarity)}
    assert got == {k: n for k, n in want.items() if n} and sum(n for (_, part), n in want.items() if part == "removed_by_similarity") >= 3


def test_prepared_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    documents = [(i, " ".join(rnd.choice("kamor lopin nutar velis dorin".split()) for _ in range(60 + i)) + f". Shared {i % 9}.") for i in range(40)] + [(50, documents_text := "Lone."), (51, documents_text)]
    d = tables(spark, tmp_path, documents)
    split = {r.doc_id: r.split for r in queries_corpus.QUERIES["component_split"](spark, d).collect()}
    assert len(split) == 41 and set(split.values()) == {"train", "dev", "test"}
    want, seen = Counter(), {}
    for i, spans in gold(spark, d).items():
        kept = []
        for s, e, label in sorted(set(spans), key=lambda x: (x[0] - x[1], x[0])):
            if i in split and all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, label))
        for s, e, label in kept:
            want[split[i], label, "n"] += 1
            want[split[i], label, "chars"] += e - s
            seen.setdefault((split[i], label), set()).add(i)
    got = {(r.split, r.label): (r.n, r.chars, r.documents) for r in queries_more.prepared(spark, d).collect()}
    assert got == {k: (want[*k, "n"], want[*k, "chars"], len(v)) for k, v in seen.items()} and len(got) > 2


def test_quality_reasons_read_all_spans(spark, tmp_path):
    rnd = random.Random(2)
    documents = [(i, " ".join(rnd.choice("kamor lopin nutar velis dorin".split()) for _ in range(110 + i)) + " " + " ".join(rnd.choice("the of a le kamor".split()) for _ in range(i))) for i in range(60)]
    d, want = tables(spark, tmp_path, documents), {}
    spans = gold(spark, d)
    for i, t in documents:
        s = [t[x:y].lower() for x, y, _ in spans.get(i, [])]
        loose = any(x != "of the" and x.endswith((" the", " le")) for x in s)
        want[i] = "length" if not 10 <= len(t) <= 1500 else "blocked_term" if {"the", "of", "a"} & set(s) else "loose_ending" if loose else None
    assert {r.doc_id: r.reason for r in queries_more.quality_reasons(spark, d).collect()} == want
    assert {"blocked_term", "loose_ending", None} <= set(want.values())


def test_documents_near_benchmark_items(spark, tmp_path):
    rnd = random.Random(6)
    items = [(i, prose(rnd, 10 + 8 * i)) for i in range(12)]
    documents = [(i, changed(rnd, t, len(t) // 15)) for i, t in items] + [(20 + i, t.upper()) for i, t in items] + [(40 + i, prose(rnd, 10 + 9 * i)) for i in range(12)]
    got = {(r.doc_id, r.item_id): r.ratio for r in queries_corpus.QUERIES["near_dup_ratio"](spark, tables(spark, tmp_path, documents, benchmark=items)).collect()}
    ratios = {(i, j): difflib.SequenceMatcher(None, norm(t), norm(u)).ratio() for i, t in documents for j, u in items}
    want = {k: v for k, v in ratios.items() if v >= 0.7}
    assert got == want and 12 < len(want) < 40


def test_every_document_is_curated(spark, tmp_path):
    rnd = random.Random(7)
    documents = [(i, " ".join(rnd.choice("filing sheet printer office ledger".split()) for _ in range(rnd.randrange(1, 4)))) for i in range(45)]
    turns = [(1, i, "user", t) for i, t in enumerate(["own words 12", "some filing", documents[0][1], documents[1][1], documents[2][1], " own words 12 ", "a filing2"])]
    d = tables(spark, tmp_path, documents, conversations=turns)
    terms = [r.term for r in inputs.terms(spark, d).collect()]
    rows = [(c * 1000 + k, t) for c, k, _, t in turns] + [(10_000_000 + i, t) for i, t in documents]
    first, parts, want = {}, [{t.strip() for i, t in documents if i % 3 == k} for k in range(3)], {}
    for i, t in rows:
        first.setdefault(t.strip(), i)
    for i, t in rows:
        k = t.strip()
        held = any(re.search(rf"(^|\W){x}($|\W)", t.lower()) for x in terms)
        want[i] = "duplicate" if first[k] != i or k in parts[0] else "test_leak" if k in parts[1] else "dev_leak" if k in parts[2] else "accidental_entity" if held else "accept"
    assert {r.idx: r.reason for r in queries_review.QUERIES["curation_reasons"](spark, d).collect()} == want
    assert set(want.values()) == {"duplicate", "test_leak", "dev_leak", "accidental_entity", "accept"}
    assert {r.augmentation_type: r.n for r in queries_review.build_pool(spark, d).collect()} == {"real": 15, "hard_negative": sum(x == "accept" for x in want.values())}
