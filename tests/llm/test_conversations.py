import random

from kbspark.llm.conversations import rebuild_conversations, session_verdicts

SCHEMA = "id long, session_id string, role string, content string, seq int, loaded_at int, op string, at int, own int, n int"


def brute(rows, known):
    last = {}
    for r in rows:
        if r["session_id"] is None:
            continue
        if r["id"] not in last or r["loaded_at"] > last[r["id"]]["loaded_at"]:
            last[r["id"]] = r
    sessions = {k: [] for k in known}
    for r in last.values():
        if r["op"] != "delete":
            sessions.setdefault(r["session_id"], []).append(r)
    out = {}
    for k, turns in sessions.items():
        by = lambda r: {"user": "u", "human": "u", "assistant": "a", "bot": "a", "ai": "a"}.get((r["role"] or "").strip().lower())
        bare = lambda r: r["content"] is None or r["content"].strip().lower() in ("", "n/a", "-", "<br>")
        turns.sort(key=lambda r: (r["seq"] is None, r["seq"] or 0))
        roles = [by(r) for r in turns]
        if not turns or all(map(bare, turns)):
            out[k] = "empty"
        elif k not in known or [r["seq"] for r in turns] != list(range(1, len(turns) + 1)) or None in roles or roles[0] == "a" or ("a", "a") in zip(roles, roles[1:], strict=False):
            out[k] = "broken"
        elif any(x == "u" and (i + 1 == len(turns) or roles[i + 1] == "u" or bare(turns[i + 1])) for i, x in enumerate(roles)):
            out[k] = "missing_reply"
        else:
            out[k] = None
    return out


def random_rows(seed, sessions=60):
    draw, rows = random.Random(seed), []
    for s in range(sessions):
        size = draw.choice([0, 1, 2, 2, 4, 6, 9])
        for k in range(size):
            role = ["user", "assistant"][k % 2] if draw.random() > 0.05 else draw.choice([None, "tool", "user", "bot"])
            seq = k + 1 if draw.random() > 0.04 else draw.choice([None, 0, 3])
            content = draw.choice(["hello", "a. b", "42"]) if draw.random() > 0.08 else draw.choice([None, " ", "N/A", "-", "<br>"])
            row = {"id": len(rows), "session_id": f"s{s}" if draw.random() > 0.02 else None, "role": role, "content": content, "seq": seq, "loaded_at": 1, "op": draw.choice([None, "create"])}
            rows.append(row)
            if draw.random() < 0.1:
                rows.append(row | {"loaded_at": 5, "op": draw.choice(["edit", "delete"]), "content": "new"})
            if draw.random() < 0.1:
                rows.append(dict(row))
    for i, r in enumerate(rows):
        r["id"] = rows[i]["id"]
    return rows, [f"s{s}" for s in range(0, sessions + 5) if s % 7]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in ("id", "session_id", "role", "content", "seq", "loaded_at", "op")) + (1, 2, 3) for r in rows], SCHEMA)


def test_verdicts_equal_brute_force(spark):
    for seed in range(3):
        rows, known = random_rows(seed)
        sessions = spark.createDataFrame([(k, 1) for k in known] + [(known[0], 1), (None, 1)], "id string, turns int")
        found = session_verdicts(frame(spark, rows), sessions, op="op")
        assert {r["session_id"]: r["reason"] for r in found.collect()} == brute(rows, set(known))


def test_conversations_are_whole_and_in_order(spark):
    rows, known = random_rows(9)
    sessions = spark.createDataFrame([(k,) for k in known], "id string")
    messages = frame(spark, rows)
    verdicts = session_verdicts(messages, sessions, op="op")
    told = rebuild_conversations(messages, verdicts, op="op").collect()
    stands = {k for k, v in brute(rows, set(known)).items() if v is None}
    assert {r["session_id"] for r in told} == stands
    for k in stands:
        own = [r for r in told if r["session_id"] == k]
        assert [r["seq"] for r in own] == list(range(1, len(own) + 1)) and all(r["turns"] == len(own) for r in own)


def test_one_long_session_and_empty_tables(spark):
    rows = [{"id": i, "session_id": "long", "role": ["user", "bot"][i % 2], "content": "x" * 50, "seq": i + 1, "loaded_at": 1} for i in range(3000)]
    sessions = spark.createDataFrame([("long",)], "id string")
    assert session_verdicts(frame(spark, rows), sessions).collect()[0]["reason"] is None
    none = frame(spark, rows).limit(0)
    assert [r["reason"] for r in session_verdicts(none, sessions).collect()] == ["empty"]
    assert session_verdicts(none, sessions.limit(0)).count() == 0
