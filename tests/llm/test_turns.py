"""Repair of conversations against all edits of short ones, and whole searches against chunks."""

import hashlib
import itertools
import operator
import random
import zlib

import pytest

from tidelog.llm import scan, turns

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv_id, turn, role, text) with faults, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hurt = zlib.crc32(name.encode()) % 20
        if hurt == 1:
            text = ""
        if hurt == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if hurt == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if hurt == 0 else 2 if hurt == 3 else 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = text.strip(WHITE)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen
                   else None if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def legal(roles):
    rest = roles[1:] if roles.startswith("s") else roles
    return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def all_repairs(rows):
    """Every (cost, audit, repaired) with at most two inserts in a row, by trying all edits."""
    found, kinds = faults(rows), []
    inserts = [()] + [((5, "I", r, ""),) for r in ("user", "assistant")] + [
        ((5, "I", a, ""), (5, "I", b, "")) for a in ("user", "assistant") for b in ("user", "assistant")]
    for (_, role, text), fault in zip(rows, found, strict=True):
        own = [((2, "D", None, None),)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            own += [((more, "K", role, text),)] + [((1 + more, "R", r, text),) for r in ("user", "assistant")]
        kinds += [inserts, own]
    for choice in itertools.product(*kinds, inserts):
        edits = [e for some in choice for e in some]
        kept = [(r, t) for _, _, r, t in edits if r is not None]
        if legal("".join(r[:1] or "?" for r, _ in kept)):
            yield sum(e[0] for e in edits), "".join(e[1] for e in edits), "\n".join(f"{r}:{t}" for r, t in kept)


def by_strings(rows):
    """The same by carrying whole letters and texts for each state."""
    found, nothing = faults(rows), (0, "", ())
    states, need = {0: nothing}, {0: "u", 1: "u", 2: "a", 3: "u"}
    step, role_of = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}

    def filled(now):
        for _ in range(4):
            for q, (cost, letters, kept) in list(now.items()):
                offer = (cost + 5, letters + "I", (*kept, (role_of[step[q]], "")))
                now[step[q]] = min(now.get(step[q], offer), offer)
        return now

    for (_, role, text), fault in zip(rows, found, strict=True):
        new = {}
        for q, (cost, letters, kept) in filled(dict(states)).items():
            offers = [(q, cost + 2, "D", kept)]
            if fault not in ("blank", "duplicate"):
                cost += 5 if fault == "truncated" else 0
                offers.append((step[q], cost + 1, "R", (*kept, (role_of[step[q]], text))))
                if role[:1] == need[q]:
                    offers.append((step[q], cost, "K", (*kept, (role, text))))
                if role[:1] == "s" and q == 0:
                    offers.append((1, cost, "K", (*kept, (role, text))))
            for to, c, letter, k in offers:
                offer = (c, letters + letter, k)
                new[to] = min(new.get(to, offer), offer)
        states = new
    ends = filled(dict(states))
    cost, letters, kept = min(ends[q] for q in (0, 3) if q in ends)
    return cost, letters, "\n".join(f"{r}:{t}" for r, t in kept)


def expected(rows):
    out = {}
    hurt = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = hurt.get(conv, [])
        found = faults(own)
        at = [t for t, _, _ in own if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, repaired = by_strings(own) if own else (0, "", "")
        out[conv] = (gaps, *(found.count(f) for f in turns.FAULTS), illegal, cost, audit,
                     hashlib.sha256(repaired.encode()).hexdigest())
    return out


def random_rows(rng, n, roles=("system", "user", "assistant"), texts=("One.", "Two!", "cut", " ", "Three?", "")):
    return [(k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(10**6)}.") for k in range(n)]


def search(rows, entry=turns.START):
    """(cost, audit, repaired, most nodes held) by the search alone."""
    out, found = turns.Out(), faults(rows)
    out.begin("c", 1, 0, entry)
    own, most = turns.Survivors(out, entry), 0
    for (turn, role, text), fault in zip(rows, found, strict=True):
        own.step((turn, role, text, role[:1], fault), role[:1], fault in turns.FAULTS[:2], fault == "truncated")
        most = max(most, held(own.root))
    beyond = [turns.INSERT * n for n in turns.TO_END]
    end = own.cheapest(beyond)
    cost = own.alive[end][0] + beyond[end]
    own.finish(end)
    out("I" * turns.TO_END[end], ())
    letters = "".join(r[4] for r in out.rows)
    return cost, letters, "\n".join(f"{r[6]}:{r[7]}" for r in out.rows if r[4] != "D"), most


def held(root):
    nodes = [root]
    for node in nodes:
        nodes.extend(node.kids)
    return len(nodes)


def test_search_finds_the_cheapest_edits_of_short_conversations():
    rng = random.Random(4)
    for n in range(4):
        for _ in range(12 if n == 3 else 40):
            rows = random_rows(rng, n, ("system", "user", "assistant", "tool", ""))
            best = min(all_repairs(rows))
            assert search(rows)[:3] == best == by_strings(rows)


def test_search_equals_whole_strings_on_longer_conversations():
    rng = random.Random(9)
    for roles in (("system", "user", "assistant"), ("user",), ("assistant", "user"), ("assistant",), ("system",), ("tool", "user", "unit")):
        for n in (5, 12, 40, 90):
            for _ in range(12):
                rows = random_rows(rng, n, roles)
                assert search(rows)[:3] == by_strings(rows)


def test_what_is_held_does_not_grow_with_the_conversation():
    rng = random.Random(2)
    sizes = []
    for n in (200, 4000):
        rows = [(k, "user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(n)]
        for at in rng.sample(range(n), n // 10):
            rows[at] = (at, rng.choice(["user", "assistant", "tool"]), rng.choice(["cut", "", "Fine."]))
        sizes.append(search(rows)[3])
    assert sizes[1] < 200


@pytest.mark.parametrize("chunk", [1, 5, 20_000])
def test_chunks_give_the_same_edits(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for conv, n in ((1, 60), (2, 3), (None, 17), (4, 1), (5, 33), (6, 0)):
        rows += [(conv, None if rng.random() < 0.1 else rng.randrange(n + 3), rng.choice(["user", "assistant", "system", "tool", None, ""]),
                  rng.choice([None, "", "Yes.", "No!", "cut off", " \t", f"words {rng.randrange(99)}."])) for _ in range(n)]
    rows += [(7, k, "user", "the same, always.") for k in range(25)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    frame = frame.selectExpr("*", "'x' as key", "'x' as chunk", "1 as cost")
    got = {r.conv_id: tuple(r)[1:] for r in turns.audited(frame, chunk).collect()}
    assert got == expected(rows)


def test_levels_of_products(spark):
    """With parts of two rows there are levels; sums of numbers are products too."""
    rows = [("a", k, [k]) for k in range(11)] + [("b", 0, [5])]
    frame = spark.createDataFrame(rows, "key string, number bigint, value array<bigint>").repartition(3)
    got = {(r.key, r.number): r.value[0] for r in scan.before(frame, operator.add, [0], fan=2).collect()}
    assert got == {("a", k): k * (k - 1) // 2 for k in range(11)} | {("b", 0): 0}


def test_whole_table(spark, folder):
    frame = spark.read.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in turns.audited(frame).collect()}
    assert got == expected([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert turns.audited(frame.limit(0)).count() == 0
