import hashlib

from loopweave.llm import line_dedup as ld


def distance_one(a, b):
    """Word edit distance of at most one, by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] <= 1


def brute(rows, least=ld.LEAST_WORDS):
    """(doc_id, n_lines, n_kept, n_exact, n_near, md5) by comparing all pairs of lines."""
    lines = [((d is not None, d or 0), i, tuple(t.encode().split()), d) for d, text in rows
             for i, t in enumerate((text or "").split("\n"))]
    lines = sorted(x for x in lines if x[2])
    seen, first = {}, []
    for place in lines:
        if place[2] not in seen:
            seen[place[2]] = place
            first.append(place)
    near = {x[2] for n, x in enumerate(first) for y in first[:n]
            if max(len(x[2]), len(y[2])) >= least and abs(len(x[2]) - len(y[2])) < 2
            and distance_one(x[2], y[2])}
    out = []
    for d in {d for d, _ in rows}:
        own = [x for x in lines if x[3] == d]
        firsts = [x for x in own if seen[x[2]] == x]
        kept = [x[1] for x in firsts if x[2] not in near]
        out.append((d, len(own), len(kept), len(own) - len(firsts), len(firsts) - len(kept),
                    hashlib.md5(",".join(map(str, kept)).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(rnd):
    base = [[f"w{rnd.randrange(30)}" for _ in range(rnd.choice([1, 3, 8, 9, 10, 11, 12, 25]))]
            for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randrange(8)):
            words = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(words))
                action = rnd.randrange(3)
                if action == 0:
                    words[at] = f"x{rnd.randrange(3)}"
                elif action == 1 and len(words) > 1:
                    del words[at]
                else:
                    words.insert(at, rnd.choice([words[at], "ins"]))
            lines.append(rnd.choice([" ", "\t", "  "]).join(words))
        rows.append((d, "\n".join(lines + rnd.choice([[], [""], ["", " "]]))))
    return rows


def test_report_equals_brute_force(table, rnd):
    for _ in range(3):
        rows = corpus(rnd)
        got = ld.line_report(table("doc_id long, text string", rows, 5)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edge_cases(table):
    long = " ".join(f"t{i}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, long), (5, long.replace("t77 ", "")),
            (6, "same line\r\nsame line\nÉ same"), (7, " same\tline"), (None, "same line")]
    got = ld.line_report(table("doc_id long, text string, line int", [(*r, 0) for r in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert ld.line_report(table("doc_id long, text string", [])).count() == 0


def test_rows_that_repeat_an_id_are_one_document(table):
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "a b\nc d\ne")]
    got = {r.doc_id: r for r in ld.line_report(table("doc_id long, text string", rows)).collect()}
    assert (got[1].n_lines, got[1].n_kept) == (3, 2) and (got[2].n_lines, got[2].n_kept) == (3, 1)


def test_texts_without_the_dropped_lines(table):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, f"head\n\n{ten}", "a"), (2, f"{ten.replace('five', 'V')}\nhead\n\nnew", "b"),
            (3, None, "c"), (4, f"{ten} more and more", "d")]
    docs = table("doc_id long, text string, _kept string", rows)
    got = ld.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {
        1: rows[0][1], 2: "\nnew", 3: None, 4: rows[3][1]}


def test_a_hot_line_and_its_variants_make_no_pairs(table):
    base = [f"w{i}" for i in range(12)]
    rows = [(d, " ".join(base[:3] + [f"v{d}"] + base[3:])) for d in range(400)]
    got = ld.line_report(table("doc_id long, text string", rows)).collect()
    assert sum(r.n_kept for r in got) == 1 and sum(r.n_near for r in got) == 399
