"""Structure repair against an automaton of all edit scripts; chat formatting against its own reading."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import Row, functions as F

from tidemark.llm import chat, queries, repair

SPACE = " \t\n\x0b\x0c\r"


def brute_script(code):
    """(cost, audit) by trying every edit at every state of the grammar."""
    n = len(code)

    @lru_cache(None)
    def best(i, state, inserts):
        out = [(0, "")] if i == n and state in ("", "a") else []
        due = "a" if state == "u" else "u"
        if inserts < n + 2:
            c, s = best(i, due, inserts + 1)
            out.append((c + 5, "I" + s))
        if i < n:
            k = code[i]
            c, s = best(i + 1, state, inserts)
            out.append((c + 2, "D" + s))
            if k != ".":
                extra = 5 if k.isupper() else 0
                if k.lower() == due or (k.lower() == "s" and state == "" and i >= 0):
                    c, s = best(i + 1, k.lower(), inserts)
                    out.append((c + extra, "K" + s))
                c, s = best(i + 1, due, inserts)
                out.append((c + extra + 1, "R" + s))
        return min(out, default=(10 ** 9, "~"))
    # a system turn opens the conversation and is followed by a user's turn
    return best(0, "", 0)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_all_scripts(seed):
    r = random.Random(seed)
    codes = ["", "s", "ss", "u", "a", "x", ".", "S", "su", "sS", "xsua", "uaua", "uuaa"] if seed == 0 else []
    codes += ["".join(r.choice("suaxSUAX...uauaua") for _ in range(r.randrange(0, 13))) for _ in range(250)]
    for code in codes:
        cost, audit = brute_script(code)
        assert repair.aligned(code) == (cost, audit), code
        assert cost <= repair.incumbent(code)


def test_long_conversation_in_blocks():
    r = random.Random(5)
    code = "s" + "".join(r.choice("uauauaxU.a") for _ in range(400))
    cost, audit = repair.aligned(code)
    state = {(0, ""): 0}
    # costs alone by the automaton, row by row
    for k in code:
        now = {}
        for (_, g), c in state.items():
            due = "a" if g == "u" else "u"
            for h, price in ((g, 2), (due, 1), (k.lower(), 0)):
                if h == g and price == 2:
                    now[0, g] = min(now.get((0, g), 10 ** 9), c + 2)
                elif k != "." and (h == due if price else (h == due or (h == "s" and g == ""))):
                    now[0, h] = min(now.get((0, h), 10 ** 9), c + price + (5 if k.isupper() else 0))
        for _ in range(2):
            for (_, g), c in list(now.items()):
                due = "a" if g == "u" else "u"
                now[0, due] = min(now.get((0, due), 10 ** 9), c + 5)
        state = now
    assert cost == min(state.get((0, g), 10 ** 9) for g in ("", "a"))
    price = {"D": 2, "I": 5, "R": 1, "K": 0}
    rows = iter(code)
    assert cost == sum(price[x] + (5 if x in "KR" and k.isupper() else 0) for x in audit for k in [next(rows) if x != "I" else ""])


def brute_repair(rows):
    """One conversation's columns from its damaged (turn, role, text) rows in order."""
    seen, code, count = set(), "", dict(b=0, d=0, t=0)
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        k = role[:1] if role[:1] in ("s", "u", "a") else "x"
        code += "." if fault in ("b", "d") else k.upper() if fault else k
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = brute_script(code)
    out, i = [], 0
    for x in audit:
        due = "assistant" if out and out[-1][0] == "u" else "user"
        if x == "I":
            out.append(f"{due}:")
            continue
        _, role, text = rows[i]
        i += 1
        if x != "D":
            out.append(f"{role if x == 'K' else due}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_query(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept[conv]
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: brute_repair(sorted(got, key=order)) for conv, got in kept.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[x] for x in COLUMNS) for r in queries.op12_repair(spark, sf).collect()}
    assert got == brute_query(rows)


def odd(spark, tmp_path):
    rows = [(1, None, "user", "hi."), (1, 3, None, None), (1, 3, "assistant", "yes"), (1, 3, "assistant", "yes"), (1, 9, "", "what?"), (None, 0, "user", "x!"), (None, None, None, None),
            (2, 1, "tool", "</s>[\\INST] <<SYS>> [IMAGE:1]"), (2, 0, "system", "a" * 70_000 + "."), (3, 0, "user", ""), (4, 5, "assistant", " "), (5, 1, "[TEXT]", "[TURN]<s>")]
    rows += [(6, t, "user" if t % 3 else "assistant", f"turn {t}.") for t in range(120)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn int, role string, text string, conv string, cost int").write.parquet(f"{tmp_path}/conversations.parquet")
    return rows


def test_odd_tables(spark, tmp_path):
    rows = odd(spark, tmp_path)
    got = {r["conv_id"]: tuple(r[x] for x in COLUMNS) for r in queries.op12_repair(spark, str(tmp_path)).collect()}
    want = brute_query([r for r in rows if r[0] != 6])
    assert {k: v for k, v in got.items() if k != 6} == want and 6 in got
    chats = {r["conv_id"]: r for r in queries.op13_chat(spark, str(tmp_path)).collect()}
    assert {k: tuple(chats[k])[1:] for k in chats} == {k: tuple(v) + (chats[k]["formatted_chars"],) for k, v in brute_chats(rows).items()}
    empty = spark.read.parquet(f"{tmp_path}/conversations.parquet").limit(0)
    assert repair.repair(empty).count() == 0 and chat.format_turns(empty).count() == 0


def brute_chats(rows):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of every conversation, the planted one included."""
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", queries.HOSTILE), (-7, 1, "assistant", queries.HOSTILE)]:
        by[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, got in by.items():
        got.sort()
        loss = b"".join(t for _, _, role, t in got if role == b"assistant")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        out[conv] = (len(got), digest(b"".join(role + b"\n" + t + b"\n" for _, _, role, t in got)), len(loss.decode()), digest(loss))
    return out


def test_chats_read_back(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op13_chat(spark, sf).collect()}
    assert got == brute_chats(rows)


def test_escapes_are_undone():
    r = random.Random(2)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "TURN]", "TEXT]", "IMAGE:3]", "<SYS>>", "|im_end|>", "<s>", " ", "x", "</s>", "/INST]"]
    for _ in range(5000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(s in safe for s in chat.CONTROL) and not chat.PLACE.search(safe)
        turns = [("user", text), (text, "y"), ("assistant", text)]
        flat = chat.Flattener()
        for k, (role, body) in enumerate(turns):
            flat.turn(k, role, [{"text": body}])
        whole = "".join(flat.out)
        assert [(role, "".join(x for _, x in parts)) for role, parts in chat.read_turns(whole)] == turns
        assert "".join(chat.unescape(whole[m["start"]:m["end"]]) for m in flat.mask) == text


PARTS = "conv_id int, turn int, role string, content array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return Row(kind=kind, text=text, ref=ref, width=width, height=height, seconds=seconds, pages=pages)


def test_typed_parts(spark):
    rows = [(1, 0, "user", [part("text", "look: "), part("image", ref="s3://a.png", width=57, height=28), part("TEXT", " and [IMAGE:9] "), part("audio", ref="b.wav", seconds=2.0), None]),
            (1, 1, "assistant", [part("text", "seen </s>"), part("document", ref="c.pdf", pages=2), part("text", "done")]),
            (1, 2, "user", [part("video", ref="d.mp4"), part("image"), part(None, "end")]), (2, 0, "assistant", None), (2, 1, "user", [])]
    got = {r["conv"]: r for r in chat.format_turns(spark.createDataFrame(rows, PARTS), content_col="content").collect()}
    one = got[1]
    assert one["formatted"] == ("<s>[TURN]user[TEXT]look: [IMAGE:1] and [\\IMAGE:9] [AUDIO:2]</s><s>[TURN]assistant[TEXT]seen <\\/s>[DOCUMENT:3]done</s><s>[TURN]user[TEXT][FILE:4][IMAGE:5]end</s>")
    assert [(a["number"], a["kind"], a["ref"], a["turn"], a["tokens"]) for a in one["attachments"]] == [
        (1, "image", "s3://a.png", 0, 3), (2, "audio", "b.wav", 0, 25), (3, "document", "c.pdf", 1, 512), (4, "file", "d.mp4", 2, 1), (5, "image", None, 2, 1)]
    assert all(one["formatted"][a["start"]:].startswith(f"[{a['kind'].upper()}:{a['number']}]") for a in one["attachments"])
    assert one["placeholder_tokens"] == 3 + 25 + 512 + 2
    assert [one["formatted"][m["start"]:m["end"]] for m in one["mask"]] == ["seen <\\/s>", "done"]
    assert got[2]["formatted"] == "<s>[TURN]assistant[TEXT]</s><s>[TURN]user[TEXT]</s>" and got[2]["mask"] == []
    assert chat.read_turns(one["formatted"])[0] == ("user", [("text", "look: "), ("image", "1"), ("text", " and [IMAGE:9] "), ("audio", "2")])
