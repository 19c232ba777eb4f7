import random
import re
from collections import Counter, defaultdict

from sanmaru.llm.quotes import link_quotations, write_conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth string, parent_turn string"


def hashes(words):
    return [" ".join(words[i : i + 8]) for i in range(len(words) - 7)] if len(words) >= 8 else [" ".join(words)]


def brute(rows):
    """Parents and paths of messages with distinct (conv_id, turn)."""
    said, quoted = defaultdict(dict), defaultdict(list)  # hash: {conversation: first turn}; message: (level, hash, long)
    for c, t, _, text, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        own, level, words = [], 0, []
        for line in (text or "").split("\n") + ["end"]:
            marks = re.match(r"(?:[ \t]*>)+[ \t]?", line)
            body = (line[marks.end() :] if marks else line).lower().split()
            now = marks[0].count(">") if marks and body else 0
            if now != level and words:
                quoted[c, t] += [(level, h, len(words) >= 8) for h in dict.fromkeys(hashes(words))]
                words = []
            level = now
            words += body if now else []
            if not marks:
                own.append(body)
        own.pop()
        flat = [w for line in own for w in line]
        for h in (hashes(flat) if len(flat) >= 8 else []) + [" ".join(line) for line in own if 0 < len(line) < 8]:
            said[h].setdefault(c, t)
    best, extra = {}, defaultdict(Counter)
    for (c, t), found in quoted.items():
        votes = defaultdict(Counter)
        for level, h, long in found:
            if said[h].get(c, t) < t:
                votes[level][True, c, said[h][c]] += 1
            first = min(((turn, conv) for conv, turn in said[h].items() if conv != c), default=None)
            if first and (long or len(said[h]) == 1):
                votes[level][False, first[1], first[0]] += 1
        best[c, t] = [max((same, n, turn, conv) for (same, conv, turn), n in votes[level].items()) for level in sorted(votes)]
        for low, high in zip(best[c, t], best[c, t][1:]):
            if high[3] != low[3] or high[2] < low[2]:
                extra[low[3], low[2]][high[3], high[2]] += high[1]
    parent = {m: (b[0][3], b[0][2]) for m, b in best.items() if b}
    for m, above in extra.items():
        parent.setdefault(m, max((n, turn, conv) for (conv, turn), n in above.items())[:0:-1])
    for m in sorted(parent, key=lambda m: m[::-1]):  # the smallest turn and conversation of a ring starts its thread
        p = m
        for _ in range(len(parent) + 1):
            p = parent.get(p)
            if p in (None, m):
                break
        if p == m:
            del parent[m]
    path = {}
    for c, t, *_ in rows:
        p = [(c, t)]
        while p[-1] in parent:
            p.append(parent[p[-1]])
        path[c, t] = p[::-1]
    return parent, path


def thread(seed):
    rng, rows = random.Random(seed), []
    for conv in range(6):
        lines: list[list[str]] = []
        for turn in range(rng.randrange(2, 14)):
            own = [f"line {rng.randrange(40)} of {conv if rng.random() < 0.8 else 0}" for _ in range(rng.randrange(1, 4))]
            text = list(own)
            if turn and rng.random() < 0.7:
                source = rng.randrange(turn)
                text = [">" + rng.choice(["", " "]) + x.upper() for x in lines[source]] + own
                if rng.random() < 0.5:
                    text = [">> " + x for x in rng.choice(lines)] + text
            lines.append(own)
            rows.append((conv, turn, "user", "\n".join(text), "clash", "c"))
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = thread(seed)
        parent, path = brute(rows)
        got = link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.parent_conv, r.parent_turn) == parent.get((r.conv_id, r.turn), (None, None)) and r.depth == len(r.reply_path) - 1
            assert [tuple(m) for m in r.reply_path] == path[r.conv_id, r.turn]
            assert not any(line.lstrip().startswith(">") for line in r.text.split("\n"))


def test_odd_rows_and_long_chain(spark):
    chain = [(1, t, "user", (f"> word {t - 1}\n" if t else "") + f"word {t}", "", "") for t in range(40)]
    rows = chain + [(2, 0, None, None, "", ""), (2, 1, "user", "> nothing known\n\nreply\n", "", ""), (None, 3, "user", "> word 1", "", ""), (3, 5, "user", "x" * 100_000, "", ""), (3, 5, "user", "x" * 100_000, "", "")]
    got = link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    last = max((r for r in got if r.conv_id == 1), key=lambda r: r.turn)
    assert last.depth == 39 and last.text == "word 39" and [m.turn for m in last.reply_path] == list(range(40))
    texts = {(r.conv_id, r.turn): r.text for r in got}
    assert texts[2, 0] == "" and texts[2, 1] == "reply"
    assert link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rewrapped_shortened_nested_and_foreign_quotes(spark):
    first = "The quick brown fox jumps over the lazy dog while the\nmoon is rising slowly behind the old mill on the hill"
    wrapped = "> the quick brown fox jumps over\n> the lazy dog while the moon is rising\n> slowly behind the old mill\n\nI agree"
    rows = [
        (1, 0, "a", first, "", ""), (1, 1, "b", wrapped, "", ""), (1, 2, "a", "Thanks", "", ""), (1, 3, "b", "> Thanks\nWelcome", "", ""),
        (1, 4, "c", "no quote at all but some other words in here", "", ""),
        (1, 5, "a", ">> The quick brown fox jumps over the lazy dog while\n> no quote at all but some other words in here\nfine", "", ""),
        (2, 0, "d", "> moon is rising slowly behind the old mill on the hill\nseen elsewhere", "", ""), (2, 1, "e", "> Thanks\nodd", "", ""),
    ]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 1] == (1, 0) and got[1, 3] == (1, 2) and got[2, 0] == (1, 0)
    assert got[2, 1] == (1, 2)  # a short passage that only one conversation says
    assert got[1, 5] == (1, 4) and got[1, 4] == (1, 0)  # the second level tells what the first replied to


def test_quotes_of_any_other_conversation_and_rings(spark):
    """Whatever the numbers of conversations; short passages only if one conversation says them."""
    long = "these are twenty words that only one message of all says so that a quote of it can be found again anywhere"
    rows = [
        (1, 0, "a", "> " + long + "\nlower number", "", ""), (2, 3, "a", long, "", ""), (3, 0, "a", "> " + long + "\nhigher number", "", ""), (5, 0, "a", "> see you\nok", "", ""), (6, 1, "a", "see you", "", ""),
        (7, 0, "a", "> good morning\nok", "", ""), (8, 1, "a", "good morning", "", ""), (9, 1, "a", "good morning", "", ""),
    ]
    words = [f"{c}1 {c}2 {c}3 {c}4 {c}5 {c}6 {c}7 {c}8 {c}9" for c in "xyz"]
    rows += [(20 + i, i, "a", f"> {words[(i + 1) % 3]}\n{words[i]}", "", "") for i in range(3)]  # 20 quotes 21, 21 quotes 22, 22 quotes 20
    rows += [(30, 9, "a", f"> {words[1]}\nfrom outside", "", ""), (40, 0, "a", f"> {words[0].upper()} x1\n> and more\n{words[0]} later", "", "")]
    got = {(r.conv_id, r.turn): ((r.parent_conv, r.parent_turn), r.depth) for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0] == got[3, 0] == ((2, 3), 1) and got[5, 0] == ((6, 1), 1) and got[7, 0] == ((None, None), 0)
    assert got[20, 0] == ((None, None), 0) and got[22, 2] == ((20, 0), 1) and got[21, 1] == ((22, 2), 2) and got[30, 9] == ((21, 1), 3)
    parent, path = brute(rows)
    assert all(v[0] == parent.get(k, (None, None)) for k, v in got.items())


def test_write_conversations(spark, tmp_path):
    linked = link_quotations(spark.createDataFrame(thread(3), SCHEMA))
    write_conversations(linked, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, linked.collect()))
