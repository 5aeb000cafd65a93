import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemill.llm import dialog_repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def all_edits(rows):
    """Every way to edit the turns, at most two insertions at a place: (cost, audit, repaired)."""
    gaps = ["", "u", "a", "ua", "au"]
    per = []
    for role, text, fault in rows:
        ways = [("D", 4, None, None)]
        if fault in ("ok", "truncated"):
            extra = 3 if fault == "truncated" else 0
            ways += [("K", extra, role[:1], f"{role}:{text}"), ("R", extra + 3, "u", f"user:{text}"), ("R", extra + 3, "a", f"assistant:{text}")]
        per.append(ways)
    for ways in product(*per):
        for inserts in product(gaps, repeat=len(rows) + 1):
            roles = audit = ""
            cost, text = 0, []
            for k, more in enumerate(inserts):
                roles += more
                audit += "I" * len(more)
                cost += 3 * len(more)
                text += [{"u": "user:", "a": "assistant:"}[c] for c in more]
                if k < len(ways):
                    audit += ways[k][0]
                    cost += ways[k][1]
                    if ways[k][2] is not None:
                        roles += ways[k][2]
                        text.append(ways[k][3])
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, audit, "\n".join(text)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(WHITE)
        out.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "ok"))
        seen.add((role, text))
    return out


def programme(rows):
    repair = dialog_repair.Repair(dialog_repair.Joined)
    for k, (role, text, fault) in enumerate(rows):
        repair.add(k, role, text, fault)
    return repair.finish()


@pytest.mark.parametrize("seed", range(60))
def test_against_all_edits(seed):
    r = random.Random(seed)
    rows = faults([(r.choice(["user", "assistant", "system", "user", "assistant", "tool", " "]), r.choice(["Hi.", "Yes!", "", "so", "é\n"])) for _ in range(r.randint(0, 4))])
    assert programme(rows) == min(all_edits(rows))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode()))


def expected(rows):
    hurt = damaged(rows)
    for conv in {x[0] for x in rows}:
        mine = [x for x in hurt if x[0] == conv]
        flawed = faults([x[2:] for x in mine])
        turns = [x[1] for x in mine if x[1] is not None]
        cost, audit, text = programme(flawed)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f[2] == name for f in flawed) for name in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )


def test_query_with_odd_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(conv, turn, r.choice(["system", "user", "assistant", None, ""]), r.choice(["Well.", "No", "", None, "A\n b?", " \t"])) for conv in [*range(40), None] for turn in [None, *range(-1, r.randint(0, 9))]]
    rows += [(1, 2, "user", "Tie."), (1, 2, "user", "Tie."), (2, 0, "assistant", "x" * 300_000 + "."), (50, 7, "user", "Only one.")]
    rows += [(60, k, ["user", "assistant"][k % 2], f"Turn {k}.") for k in range(3000)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = dialog_repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(map(repr, expected(rows)))


def test_texts_empty_table_and_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 1, 2), (1, 1, "user", "There.", 1, 2)], SCHEMA + ", cost int, Digest int")
    got = dialog_repair.repair(rows, with_text=True).first()
    assert (got.cost, got.audit, got.repaired) == (3, "KR", "user:Hi.\nassistant:There.")
    assert dialog_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    assert dialog_repair.damage(rows).select(F.max("turn")).first()[0] is not None
