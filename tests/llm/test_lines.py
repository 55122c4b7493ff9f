"""Line dedup against a plain loop over fingerprints, and the guarantee of winnowing."""

from dunlake.llm.lines import GRAM_LINES, WINDOW, clean_lines, dedup_lines, extend, winnow, without_lines
import numpy as np

SCHEMA = "doc_id long, text string, lines string, at int"
LEAST = GRAM_LINES + WINDOW - 1


def corpus(rng, n=100):
    pool = [f"line {i} x" for i in range(12)] + ["   ", ""]
    docs = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"own {rng.random()}" for _ in range(rng.randrange(12))]
        if docs and rng.random() < 0.5:
            source = (rng.choice(docs)[1] or "").split("\n")
            at = rng.randrange(len(source))
            lines[len(lines) // 2 : len(lines) // 2] = source[at : at + rng.randrange(1, 8)]
        if rng.random() < 0.05:
            lines = ["same"] * 30
        docs.append((i if i != 33 else None, "\n".join(lines) if rng.random() > 0.03 else None, "x", 1))
    return [*docs, docs[4], (10**6, "", "y", None)]


def wordy(text):
    return [line for line in (text or "").split("\n") if line.strip(" \t\v\f\r")]


def hashes(lines):
    """Any injective numbering serves for the extension; fingerprints are checked by their effect."""
    return np.array([hash(line) & 0xFFFFFFFFFFFF for line in lines], np.uint64)


def test_every_repeated_run_loses_lines_and_only_repeats_go(spark, rng):
    docs = corpus(rng)
    rows = dedup_lines(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()
    assert len(rows) == len(docs)
    texts = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            texts.setdefault(doc_id, text)
    earlier = {}
    for doc_id in sorted(texts):
        lines = wordy(texts[doc_id])
        for at in range(len(lines) - 1):
            earlier.setdefault(tuple(lines[at : at + 2]), (doc_id, at))
    for row in rows:
        if row.doc_id is None:
            assert row.n_removed == 0
            continue
        lines, left = wordy(texts[row.doc_id]), wordy(row.text)
        assert row.n_lines == len(lines) and row.n_removed == len(lines) - len(left)
        # what is left is a subsequence, and each deleted line is part of a pair of lines that begins earlier
        at, gone = 0, []
        for i, line in enumerate(lines):
            if at < len(left) and left[at] == line and len(left) - at <= len(lines) - i and (len(lines) - i > len(left) - at) is False:
                at += 1
            elif at < len(left) and left[at] == line:
                at += 1
            else:
                gone.append(i)
        assert at == len(left)
        repeated = [i for i in range(len(lines) - 1) if earlier[tuple(lines[i : i + 2])] != (row.doc_id, i)]
        covered = {i + k for i in repeated for k in (0, 1)}
        assert len(gone) <= len(covered)
        if row.n_removed == 0:
            # the guarantee: three lines in a row that all begin earlier at one place would have been found
            for i in range(len(lines) - LEAST + 1):
                first = earlier[tuple(lines[i : i + 2])], earlier[tuple(lines[i + 1 : i + 3])]
                together = first[0] != (row.doc_id, i) and first[0][0] == first[1][0] and first[1][1] == first[0][1] + 1
                assert not (together and earlier[tuple(lines[i + 1 : i + 3])] != (row.doc_id, i + 1))


def test_shared_passage_goes_from_later_documents(spark):
    passage = [f"passage {i}" for i in range(6)]
    docs = [(i, "\n".join([f"head {i}", *passage, "", f"tail {i}"]), "x", 1) for i in range(50)]
    rows = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()}
    assert rows[0].text == docs[0][1] and rows[0].n_removed == 0
    for i in range(1, 50):
        assert rows[i].text == f"head {i}\n\ntail {i}" and (rows[i].n_removed, rows[i].n_spans) == (6, 1)


def test_repeat_within_one_text(spark):
    docs = [(1, "\n".join(["a", "b", "c", "d"] * 3), "x", 1), (2, "\n".join(["z"] * 20), "x", 1), (3, "z\nz", "x", 1)]
    rows = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert rows[1].text == "a\nb\nc\nd" and rows[1].n_spans == 1
    assert rows[2].text == "z" and rows[3].text == "z\nz"


def test_winnow_chooses_one_in_each_window(rng):
    for _ in range(50):
        grams = np.array([rng.randrange(20) for _ in range(rng.randrange(30))], np.uint64)
        for window in (1, 2, 4):
            chosen = winnow(grams, window)
            for at in range(len(grams) - window + 1):
                inside = grams[at : at + window]
                assert at + int(inside.argmin()) in chosen
            assert len(grams) >= window or len(chosen) == 0


def test_extend_both_ways():
    a, b = hashes("pxabcdeq"), hashes("rabcdes")
    assert extend(a, b, [(4, 3)], 2, 3) == [(2, 7)]
    assert extend(a, b, [(4, 3), (5, 4)], 2, 3) == [(2, 7)]
    assert extend(a, b, [(4, 3)], 2, 6) == []


def test_without_lines():
    assert without_lines("a\n\nb\nc\n", [(0, 2)]) == ("c\n", 3, 2, 1)
    assert without_lines("a\nb\nc", [(0, 1), (0, 2)]) == ("c", 3, 2, 1)
    assert without_lines("", []) == ("", 0, 0, 0)


def test_empty_table_and_columns(spark, rng):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(1, "a\nb\nc\nd", "en", "s", 7), (2, "a\nb\nc\nd", "en", "s", 7), (3, "x\na\nb\nc\nd", None, None, None), (None, None, "en", "s", 0)]
    kept = clean_lines(spark.createDataFrame(docs, schema))
    assert kept.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {1, 3, None} and rows[3].text == "x" and rows[3].n_chars == 1 and rows[None].text is None


def repeated_lines(texts, counts):
    """Places of the lines in runs for which ``counts`` holds and that begin earlier anywhere, by (id, place); texts by id."""
    seen, gone = set(), set()
    for doc_id in sorted(texts):
        lines = wordy(texts[doc_id])
        for at in range(len(lines)):
            for size in (1, 2, 3):
                run = tuple(lines[at : at + size])
                if len(run) == size and counts(run):
                    if run in seen:
                        gone |= {(doc_id, at + k) for k in range(size)}
                    seen.add(run)
    return gone


def left_lines(texts, gone):
    return {i: [line for at, line in enumerate(wordy(text)) if (i, at) not in gone] for i, text in texts.items()}


def test_run_is_found_when_its_pairs_occur_earlier_elsewhere(spark, rng):
    # the pairs A B and B C of each case begin earlier in other documents than the run A B C
    cases = [[["A", "B", "x"], ["y", "B", "C"], ["a", "A", "B", "C", "b"], ["c", "A", "B", "C", "d"]] for _ in range(20)]
    texts = {4 * k + i: "\n".join(f"{line} {k}" for line in lines) for k, case in enumerate(cases) for i, lines in enumerate(case)}
    rows = dedup_lines(spark.createDataFrame([(i, text, "x", 1) for i, text in texts.items()], SCHEMA).repartition(4)).collect()
    assert all(r.n_removed == (3 if r.doc_id % 4 == 3 else 0) for r in rows)
    texts = {i: text for i, text, *_ in corpus(rng, 300)[:300] if i is not None}
    rows = dedup_lines(spark.createDataFrame([(i, text, "x", 1) for i, text in texts.items()], SCHEMA).repartition(4)).collect()
    expected = left_lines(texts, repeated_lines(texts, lambda run: len(run) == 3))
    assert {r.doc_id: wordy(r.text) for r in rows} == expected


def test_long_runs_of_one_or_two_lines_go(spark, rng):
    def words(n, key):
        return " ".join(f"w{i}{key}" for i in range(n))

    docs = [
        (1, f"{words(60, 'a')}\n{words(30, 'b')}\n\n{words(20, 'c')}\n{words(49, 'd')}"),
        (2, words(60, "a")),
        (3, f"own\n{words(30, 'b')}\n{words(20, 'c')}\nown too"),
        (4, words(49, "d")),
        (5, f"{words(60, 'a')}\n{words(30, 'b')}"),
        (6, f"{words(60, 'a')}\nshort"),
        (7, f"{words(60, 'a')}\nshort"),
    ]
    rows = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(4)).collect()}
    assert [rows[i].n_removed for i in range(1, 8)] == [0, 1, 2, 0, 2, 1, 2]
    assert rows[2].text == "" and rows[3].text == "own\nown too" and rows[6].text == "short" and rows[7].text == ""
    pool = [words(n, f"p{n}") for n in (1, 2, 15, 20, 24, 25, 26, 35, 49, 50, 51, 80)]
    texts = {i: "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randrange(9))) for i in range(300)}
    found = dedup_lines(spark.createDataFrame([(i, text, "x", 1) for i, text in texts.items()], SCHEMA).repartition(4)).collect()
    gone = repeated_lines(texts, lambda run: len(run) == 3 or sum(len(line.split()) for line in run) >= 50)
    assert {r.doc_id: wordy(r.text) for r in found} == left_lines(texts, gone)


def test_lines_built_to_collide(spark):
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = [(1, f"{one}\ns\nt", "x", 1), (2, f"{other}\ns\nt", "x", 1), (3, f"{one}\ns\nt", "x", 1)]
    rows = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    assert rows == {1: 0, 2: 0, 3: 3}
