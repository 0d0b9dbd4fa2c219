from sluiceway.llm.line_dedup import line_dedup

from .conftest import LOW

WS = " \t\n\x0b\f\r"


def expected(rows, least, docs):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(WS).translate(LOW)
            if len(k) >= least and d is not None:
                held.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        drops = [len(k := x.strip(WS).translate(LOW)) >= least and len(held.get(k, ())) >= docs and max(held[k]) != d for x in lines]
        out.append((repr(d), len(lines), sum(drops), "\n".join(x for x, gone in zip(lines, drops, strict=True) if not gone)))
    return sorted(out)


def test_against_brute_force(frame, words):
    a, b = "The very common line here", "another COMMON line, with é"
    rows = [(i, f"{a}\nline {i} of its own is here\n  {b.upper()} \t") for i in range(8)]
    rows += [(9, a), (10, None), (11, ""), (12, "\n\n"), (13, f"{a}\n{a}\n{a}"), (13, f"{a}\nother"), (None, a), (15, "short\nshort"), (16, "short"), (17, "short"), (18, f"{a}\r"), (19, words(5000) + "\n" + a), (20, f"x\n{a}\ny")]
    rows += [(30, "twice in one document only\ntwice in one document only\ntwice in one document only"), (31, "twice in one document only")]
    for least, docs in ((20, 3), (1, 2), (5, 1)):
        got = line_dedup(frame(rows), least, docs).collect()
        assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == expected(rows, least, docs)


def test_shuffled_list_of_lines(frame, monkeypatch):
    from sluiceway.llm import line_dedup as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows = [(i, f"a line that is in all of them\n{i}") for i in range(5)]
    got = line_dedup(frame(rows)).collect()
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == expected(rows, 20, 3)


def test_empty(frame):
    assert line_dedup(frame([])).collect() == []
