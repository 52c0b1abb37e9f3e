"""Exact, near and line deduplication against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, frame
from trolley.llm import exact_dedup, line_dedup, near_dups
from trolley.llm.components import components


def key(doc_id):
    return -1 if doc_id is None else doc_id


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.md5(t), 1, 1)])
def test_exact_duplicates(edges, digest):
    """Also where many texts share a digest, and only their bytes tell them apart."""
    found = exact_dedup.exact_duplicates(edges, digest).collect()
    groups = defaultdict(list)
    for doc_id, text in EDGES:
        groups[text or ""].append(doc_id)
    expected = sorted(
        (key(i), key(max(ids, key=key)), len(ids)) for ids in groups.values() for i in ids
    )
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size) for r in found) == expected
    assert sum(r.kept for r in found) == len(groups)
    assert all(key(r.doc_id) == key(r.keep_id) for r in found if r.kept)


def test_exact_stage_keeps_one_row_of_each_text(edges, nothing):
    kept = exact_dedup.keep_first_copies(edges)
    assert kept.columns == edges.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "" for _, t in EDGES})
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert exact_dedup.keep_first_copies(nothing).count() == 0


def test_the_state_goes_on_where_it_ended(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    exact_dedup.write_log(frame(spark, [(1, "a"), (2, "b")]), log)
    assert exact_dedup.keep_state(spark, log, state).count() == 2
    exact_dedup.write_log(frame(spark, [(5, "a"), (6, "c")]), log)
    found = exact_dedup.keep_state(spark, log, state).collect()
    assert sorted((r.keep_id, r.group_size) for r in found) == [(2, 1), (5, 2), (6, 1)]


def shingle_set(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_texts():
    """Two groups of near copies, one larger than a block, among texts of their own."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = list(EDGES), 100
    for size in (150, 7):
        base = [word() for _ in range(200)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + i, " ".join(word() for _ in range(60))) for i in range(40)]
    return rows


def test_near_duplicates(spark, nothing):
    rows = near_texts()
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[text or ""].append(doc_id)
    texts = sorted(classes)
    sets = [shingle_set(t) for t in texts]
    links = defaultdict(set)
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= 0.8:
                links[a].add(b)
                links[b].add(a)
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            for b in others:
                if root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    expected = []
    for a, text in enumerate(texts):
        group = least([least(classes[t]) for i, t in enumerate(texts) if root[i] == root[a]])
        for doc_id in classes[text]:
            linked = sum(len(classes[texts[b]]) for b in links[a])
            expected.append(
                (doc_id, least(classes[text]), len(classes[text]), len(links[a]), linked, group)
            )
    found = near_dups.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(len(o) for o in links.values()) > 10_000
    assert near_dups.near_duplicates(nothing).count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    docs = frame(spark, [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words"), (4, None)])
    kept = near_dups.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_near_stage_with_repeated_ids(spark):
    """An id that stays for one text does not keep the near copy that shares it."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other = f"{base} end", "quite another text of some words"
    rows = [(0, base), (1, other), (1, near), (5, f"{base} x"), (5, f"{base} y"), (None, base)]
    kept = near_dups.keep_one_of_each_group(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, base), (1, other)]
    same = [(7, near), (7, base)]
    kept = near_dups.keep_one_of_each_group(frame(spark, same)).collect()
    assert len(kept) == 1 and kept[0].text in (near, base)


def test_longer_prefixes_have_more_trees():
    for length in near_dups.LENGTHS:
        trees = max(near_dups.trees_for(length), near_dups.TREES if length == 4 else 0)
        assert 1 - (1 - 0.8**length) ** trees >= near_dups.RECALL
    assert near_dups.trees_for(4) <= near_dups.TREES < near_dups.trees_for(8) < near_dups.trees_for(16)


def pair_at(rng, similarity, words=400):
    """Two lists of words whose five-grams have about this similarity."""
    one = [f"w{rng.randint(0, 10**9)}" for _ in range(words)]
    two, lost = list(one), 0
    while lost / (words - 4) < (1 - similarity) / (1 + similarity) - 0.004:
        two[rng.randint(0, words - 1)] = f"v{rng.randint(0, 10**9)}"
        grams = [{tuple(t[i : i + 5]) for i in range(words - 4)} for t in (one, two)]
        lost = words - 4 - len(grams[0] & grams[1])
    return " ".join(one), " ".join(two)


@pytest.mark.parametrize("node", [256, 3, 1])
def test_pairs_at_the_threshold_are_candidates_at_every_prefix(spark, monkeypatch, node):
    """Also where nodes are so crowded that texts go on to the longest prefix."""
    monkeypatch.setattr(near_dups, "candidate_links", partial(near_dups.candidate_links, node=node))
    rng = random.Random(12)
    rows = []
    for i in range(12):
        one, two = pair_at(rng, 0.82)
        rows += [(10 * i, one), (10 * i + 1, two), (10 * i + 2, f"{one} more"), (10 * i + 3, f"{one} and")]
    found = near_dups.near_duplicates(frame(spark, rows)).collect()
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    for r in found:
        own = shingles[r.doc_id]
        links = sum(
            len(own & s) / len(own | s) >= 0.8 for i, s in shingles.items() if i != r.doc_id
        )
        assert r.n_links == links and r.group_id == r.doc_id // 10 * 10


def test_a_template_makes_no_large_component(spark):
    """Texts that share 40 of 100 shingles meet by thousands, and none is sent to others' blocks."""
    rng = random.Random(13)
    shared = " ".join(f"t{i}" for i in range(62))
    rows = [
        (i, f"{shared} {' '.join(f'u{rng.randint(0, 10**9)}' for _ in range(40))}") for i in range(4000)
    ]
    rows += [(10_000, f"{rows[7][1]} end"), (10_001, f"{rows[9][1]} end")]
    docs = frame(spark, rows)
    classes = (
        near_dups.signed(docs)
        .withColumn("class", F.col("doc_id"))
        .drop("doc_id")
        .cache()
    )
    links = near_dups.candidate_links(docs, classes).distinct().collect()
    assert len(links) < 10
    assert {(10_000, 7), (10_001, 9)} <= {(r.a, r.b) for r in links}


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    edges += [(200, 201), (201, 202), (202, 200), (300, 300)]
    rng.shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()))
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert found == expected | {200: 200, 201: 200, 202: 200}


def lines_by_hand(rows, separator="\n", least=5):
    units = []
    for doc_id, text in rows:
        if text is not None:
            pieces, at = text.split(separator), 0
            for n, piece in enumerate(pieces):
                end = at + len(piece) + (len(separator) if n + 1 < len(pieces) else 0)
                low = piece.encode().lower().split()
                units.append((key(doc_id), text, at, end, tuple(low)))
                at = end
    seen, gone = set(), defaultdict(list)
    for doc_id, text, at, end, words in sorted(set(units)):
        if len(words) >= least:
            if words in seen:
                gone[doc_id, text].append((at, end))
            seen.add(words)
    out = []
    for doc_id, text in rows:
        spans = gone[key(doc_id), text]
        kept, at = "", 0
        for start, end in spans:
            kept, at = kept + text[at:start], end
        out.append((doc_id, None if text is None else kept + text[at:], spans))
    return sorted(out, key=repr)


LINES = [
    (5, "Äh one two three four five\nown line of the fifth document here\nshort"),
    (2, "zero\n  ÄH One  TWO three four five\t\nshort"),
    (7, "ÄH one two three four five\n\nÄH one two three four five\nlast line with five words"),
    (7, "ÄH one two three four five\n\nÄH one two three four five\nlast line with five words"),
    (8, "last line with five words\nlast line with five words\r\n日本 é a b c\n日本 é a b c"),
]


def test_remove_repeats(spark, nothing):
    rows = EDGES[3:] + LINES
    found = line_dedup.remove_repeats(frame(spark, rows)).collect()
    as_rows = [(r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in found]
    assert sorted(as_rows, key=repr) == lines_by_hand(rows)
    assert line_dedup.remove_repeats(nothing).count() == 0


def test_remove_repeated_paragraphs(spark):
    rows = [(i, t.replace("\n", "\n\n")) for i, t in LINES] + [(9, "a\n\n\n\n\nb c d e f g\n\n")]
    found = line_dedup.remove_repeats(frame(spark, rows), separator="\n\n").collect()
    as_rows = [(r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in found]
    assert sorted(as_rows, key=repr) == lines_by_hand(rows, "\n\n")
