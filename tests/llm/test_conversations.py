"""Conversation repair against a plain search over all edits, and defined cases."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from gristmill.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, key string, cost int, result string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", 1, "r") for r in rows], SCHEMA).repartition(parts)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        tail = text.rstrip("\t\n\x0b\x0c\r ")[-1:]
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "" if tail in ".!?" else "truncated")
        seen.add((role, text))
    return out


def legal(roles):
    roles = roles[1:] if roles[:1] == "s" else roles
    return roles == "ua" * (len(roles) // 2) and len(roles) > 0


def cheapest(rows):
    """(cost, audit, repaired rows) by uniform-cost search over all edits, letter by letter; no grammar states."""
    kinds = faults(rows)
    queue, done = [(0, "", 0, ())], {}
    while queue:
        cost, audit, at, kept = heapq.heappop(queue)
        roles = "".join(r[:1] or "-" for r, _ in kept)
        if roles and not any(legal(roles + end) for end in ("", "a", "ua")):
            continue
        if at == len(rows) and (not kept or legal(roles)):
            return cost, audit, kept
        # What may follow depends on these alone; the first way here is the cheapest and least.
        if (at, roles[-1:], not kept) in done:
            continue
        done[at, roles[-1:], not kept] = True
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", at, (*kept, (role, ""))))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, kept))
            if kinds[at] not in ("blank", "duplicate"):
                extra = 5 * (kinds[at] == "truncated")
                heapq.heappush(queue, (cost + extra, audit + "K", at + 1, (*kept, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + extra + 1, audit + "R", at + 1, (*kept, (new, text))))


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def expected(rows, damaged=True):
    out = {}
    after = damage(rows) if damaged else [(c, t, *(" " if x is None else x for x in (r, s))) for c, t, r, s in rows]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, digest(*r[2:])))
        kinds, turns = faults(own), [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = cheapest(own)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def result(frame):
    rows = frame.collect()
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(got) == len(rows)
    return got


def made_up(seed, count, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", " ", "", "Why?", "because of. it ", "ok!\n", "a.b", "x"]
    roles = ["user", "assistant", "system", "tool", "", "u", "Assistant"]
    rows = []
    for conv in range(count):
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(0, most)):
            turn += rng.choice([1, 1, 1, 1, 2])
            role = rng.choice(roles[:2]) if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_search_over_all_edits(spark, seed):
    rows = made_up(seed, 250, 9)
    assert result(conversations.repair(conversations.damaged(table(spark, rows)))) == expected(rows)
    assert result(conversations.repair(conversations.undamaged(table(spark, rows)))) == expected(rows, damaged=False)


def test_ties_take_the_least_letters():
    # Delete, delete, insert (9) or keep, keep, insert...: every state and pair of symbols against the plain search.
    for length in range(4):
        for marks in itertools.product(range(16), repeat=length):
            names = [("system", "user", "assistant", "tool")[m // 4] for m in marks]
            if any(m % 4 == 2 for m in marks):
                continue
            rows = [(0, k, name, {0: f"t{k}.", 1: "", 3: f"t{k}"}[m % 4]) for k, (m, name) in enumerate(zip(marks, names))]
            signature = "".join(chr(ord("a") + m) for m in marks)
            assert conversations.Automaton().read(signature[::-1]) == cheapest(rows)[:2], signature


def test_suffixes_are_built_once():
    automaton = conversations.Automaton()
    texts = sorted(x[::-1] for x in {"eieiei", "aeieiei", "ieiei", "eieieg", "eieig"})
    read = [automaton.read(t) for t in texts]
    assert automaton.built == len({t[:k] for t in texts for k in range(1, len(t) + 1)})
    assert read == [conversations.Automaton().read(t) for t in texts]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hm."), (1, None, "user", "A."), (1, None, "assistant", "B."), (1, 2, "user", "A."), (1, 2, "assistant", None),
        (2, 5, None, "x."), (3, 7, "user", "same."), (3, 7, "user", "same."), (3, 7, "assistant", "other"), (3, 9, "user", "same."), (4, 0, "user", "\x85 "), (4, 1, "é", "é!"),
    ]
    assert result(conversations.repair(conversations.damaged(table(spark, rows)))) == expected(rows)
    assert result(conversations.repair(conversations.undamaged(table(spark, rows)))) == expected(rows, damaged=False)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rows = [(9, k, "user" if k % 2 else "assistant", f"Part {k % 700}.") for k in range(1500)] + [(100 + k // 2, k % 2, ("user", "assistant")[k % 2], "Hi." * (1 + k % 2)) for k in range(3000)]
    pieces = conversations.symbols(conversations.undamaged(table(spark, rows))).collect()
    assert len(pieces) == 4500
    assert result(conversations.repair(conversations.damaged(table(spark, rows, parts=6)))) == expected(rows)


def test_very_long_texts_and_repaired_rows(spark):
    long_text = "word " * 200_000
    rows = [(1, 0, "user", long_text + "."), (1, 1, "assistant", long_text), (1, 2, "assistant", "Done.")]
    frame = conversations.undamaged(table(spark, rows))
    assert result(conversations.repair(frame)) == expected(rows, damaged=False)
    kept = cheapest([r for r in rows])[2]
    got = [(r["role"], r["text"]) for r in conversations.repaired_rows(frame).orderBy("place").collect()]
    assert got == list(kept)


def test_all_rows_dropped_and_no_rows(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = result(conversations.repair(conversations.damaged(table(spark, [(5, gone, "user", "x.")]))))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair(conversations.damaged(table(spark, [(5, 1, "user", "x.")]).where("conv_id < 0"))).count() == 0
