"""Conversation repair: divide and conquer against all edits, and whole tables against a direct version."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import cache

from assay.llm import turns as T
from assay.llm.frames import table

FAULTY = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = FAULTY.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, found):
    """Cost and letters by plain recursion over rows and what was said last."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(n, last, inserted):
        options = []
        if n == len(initials):
            if last in ("", "a"):
                options.append((0, ""))
        else:
            rest = best(n + 1, last, 0)
            options.append((3 + rest[0], "D" + rest[1]))
            if found[n] not in ("blank", "duplicate"):
                cut = found[n] == "truncated"
                if initials[n] == follow[last] or (initials[n] == "s" and last == ""):
                    rest = best(n + 1, initials[n], 0)
                    options.append((cut + rest[0], "K" + rest[1]))
                rest = best(n + 1, follow[last], 0)
                options.append((2 + cut + rest[0], "R" + rest[1]))
        if inserted < 3:
            rest = best(n, follow[last], inserted + 1)
            options.append((2 + rest[0], "I" + rest[1]))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def rebuilt(rows, letters):
    out, left, last = [], iter(rows), ""
    for letter in letters:
        other = "assistant" if last == "u" else "user"
        role, text = (other, "") if letter == "I" else next(left)
        if letter == "D":
            continue
        role = role if letter == "K" else other
        out.append(f"{role}:{text}")
        last = role[:1]
    return out


def direct(rows):
    by = defaultdict(list)
    for conv, turn, role, text in damage(rows):
        by[conv].append((turn, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        held = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: T.HEAD], hashlib.md5(r[2].encode()).digest()))
        said, numbers = [r[1:] for r in held], [r[0] for r in held if r[0] is not None]
        found, initials = faults(said), [r[0][:1] for r in said]
        cost, letters = cheapest(tuple(initials), tuple(found))
        sha = hashlib.sha256("\n".join(rebuilt(said, letters)).encode()).hexdigest()
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", "'x' AS conv", "'x' AS kind", "1 AS there", "'x' AS block", "'x' AS b").repartition(4)
    return sorted(map(tuple, T.repair(T.damaged(df), **kw).collect()), key=str)


def codes_of(initials, found):
    return bytes(
        ("sua".find(i) if i in "sua" else 3) | (T.MUST_GO if f in ("blank", "duplicate") else 0) | (T.IS_CUT if f == "truncated" else 0)
        for i, f in zip(initials, found)
    )


def test_plain_recursion_against_all_letters():
    """The direct version itself: every string of letters tried."""
    for initials in itertools.product("suax", repeat=3):
        found = ("", "truncated", "blank")
        tries = []
        for size in range(8):
            for letters in map("".join, itertools.product("DIKR", repeat=size)):
                rows = [letter for letter in letters if letter != "I"]
                if len(rows) != 3 or rows[2] != "D":
                    continue
                lines = rebuilt([(i, "t") for i in initials], letters)
                if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)):
                    cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in letters) + (rows[1] != "D")
                    tries.append((cost, letters))
        assert min(tries) == cheapest(initials, found)


def test_divide_and_conquer_against_recursion():
    draw = random.Random(13)
    for n in range(1500):
        size = draw.randrange(0, 12)
        initials = [draw.choice("suuaax") for _ in range(size)]
        found = [draw.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in range(size)]
        codes, out = codes_of(initials, found), []
        state = T.solve(codes, 0, size, 0, T.FINISH, out)
        cost = T.backward(codes, 0, size, T.FINISH)[0]
        assert (cost, "".join(out) + T.TAIL[state]) == cheapest(tuple(initials), tuple(found))
        reach = T.forward(codes, 0, size, 0)
        assert min(r + f for r, f in zip(reach, T.FINISH)) == cost
        middle = draw.randint(0, size)
        after = T.before_block(T.block_costs(codes[middle:]), T.FINISH)
        assert T.before_block(T.block_costs(codes[:middle]), after)[0] == cost


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == direct(rows)


def test_long_conversation_in_blocks(spark):
    draw = random.Random(3)
    words = ["Yes.", "No!", "Why?", "well", "", " \n"]
    rows = [(1, n * draw.choice([1, 1, 1, 2]), draw.choice(["user", "assistant", "system", "tool"]), f"{draw.choice(words)} {n % 40}.") for n in range(700)]
    rows += [(2, -5 + n, "user", draw.choice(words)) for n in range(90)] + [(3, 9, "user", "Hi.")] * 300
    want = direct(rows)
    assert run(spark, rows, bits=4) == want and run(spark, rows) == want


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "A."), (None, None, "user", "B."), (1, None, "user", "x"), (1, None, "user", "x"),
        (1, None, "assistant", "Same."), (2, 0, "", ""), (2, 1, "", "a."), (3, 5, "assistant", "long " * 50_000 + "."),
        (4, 2**62, "user", "é北😀?"), (4, -(2**62), "user", "\u0000\u0000."), (5, 7, "user", None),
    ] + [(100 + n, 0, "user", "Only.") for n in range(60)]
    assert run(spark, rows) == direct(rows)
    nothing = [r for r in direct(rows) if r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest()]
    assert nothing and all(r[1:7] == (0,) * 6 for r in nothing if r[0] is not None and r[0] >= 100)
    assert run(spark, []) == []
