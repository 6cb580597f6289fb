import random
import re

import pytest
from pyspark.sql import functions as F

from loomdex.llm import chat, queries

TALK = [
    (1, 0, "user", "Hello there\nI have a question about X."),
    (1, 1, "user", "Different topic entirely"),
    (1, 2, "assistant", "On Monday, Bob wrote:\n> I have a question about  x.\nSure, ask."),
    (1, 3, "user", ">> I have a question about X.\n> Sure, ask.\n\nOK here it is"),
    (1, 4, "assistant", "> Different topic entirely\nNo\n> never said this\n"),
    (1, 5, "user", None),
    (1, 3, "user", "a repeated turn"),
    (2, 0, None, "> nothing"),
    (2, 1, "user", "> nothing\n> at all"),
    (None, None, "user", "a > b"),
]


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame(TALK, "conv_id bigint, turn bigint, role string, text string").withColumn("origin", F.lit("own")).withColumn("row", F.lit(1))


def test_links_order_and_text(talk):
    rows = chat.format_chat(talk).collect()
    assert len(rows) == len(TALK)
    one = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["position"] for r in one] == list(range(7))
    assert [(r["turn"], r["root_turn"]) for r in one] == [(0, 0), (2, 0), (3, 0), (3, 0), (1, 1), (4, 1), (5, 5)]
    by = {(r["turn"], r["text"]): r for r in one}
    assert by[2, "Sure, ask."]["reply_to"] == 0
    assert by[3, "OK here it is"]["reply_to"] == 2 and by[3, "OK here it is"]["n_linked"] == 2
    assert by[4, "No"]["reply_to"] == 1 and by[4, "No"]["unlinked"] == ["never said this"]
    assert all(">" not in r["text"] for r in one)
    two = {r["turn"]: r for r in rows if r["conv_id"] == 2}
    assert two[0]["role"] == "unknown" and two[0]["unlinked"] == ["nothing"] and two[1]["reply_to"] is None
    none = next(r for r in rows if r["conv_id"] is None)
    assert none["turn"] is None and none["text"] == "a > b" and none["root_turn"] is None


def test_long_chain_and_hot_conversation(spark):
    """Every message quotes the one before; one conversation holds most rows."""
    rows = [(1, t, "user", f"> message number {t - 1}\nmessage number {t}" if t else "message number 0") for t in range(300)]
    rows += [(c, 0, "user", "hi") for c in range(2, 100)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = [r for r in chat.format_chat(d).where("conv_id = 1").collect()]
    assert all(r["root_turn"] == 0 and r["position"] == r["turn"] and r["reply_to"] == (r["turn"] - 1 if r["turn"] else None) for r in got)


def test_without_quotes_turns_stay(spark, sf):
    got = queries.op5_chat(spark, sf)
    src = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got.count() == src.count()
    place = {(r["conv_id"], r["turn"]): r["position"] for r in got.collect()}
    seen = {}
    for r in src.orderBy("conv_id", "turn").collect():
        if not re.search(r"(?m)^[ \t]*>", r["text"]):
            assert place[r["conv_id"], r["turn"]] == seen.setdefault(r["conv_id"], 0)
        seen[r["conv_id"]] += 1


def test_render_and_empty(talk):
    out = {r["conv_id"]: r["chat"] for r in chat.render(chat.format_chat(talk)).collect()}
    assert out[2] == "<|unknown|>\n\n<|user|>\n\n"
    assert chat.format_chat(talk.limit(0)).count() == 0


def test_main_path_is_native(talk):
    assert not re.search("Python|Pandas|Arrow", chat.parsed(talk)._jdf.queryExecution().executedPlan().toString())


def test_negative_and_null_turns_and_long_attributions(spark):
    rows = [(1, -3, "a", "the first thing said here"), (1, -1, "b", "> the first thing said here\nanswer one"), (1, None, "c", "no turn at all"), (1, 4, "d", "On " + "x" * 900 + " wrote:\n> answer one\nlast"), (2, -1, "e", "alone")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(((r["conv_id"], r["position"], r["turn"], r["root_turn"], r["reply_to"], r["text"]) for r in chat.format_chat(d).collect()))
    assert got == [(1, 0, None, None, None, "no turn at all"), (1, 1, -3, -3, None, "the first thing said here"), (1, 2, -1, -3, -3, "answer one"), (1, 3, 4, -3, -1, "last"), (2, 0, -1, -1, None, "alone")]


LOW = -(1 << 63) - 1


def plain(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").lower()


def parse(text):
    """Own text and quotes (level, text), line by line."""
    lines, marked = text.split("\n"), lambda x: re.match(r"[ \t]*>", x)
    if not any(map(marked, lines)):
        return text, []
    runs = []
    for i, line in enumerate(lines):
        after = next((x for x in lines[i + 1 :] if x.strip(" \t")), "")
        if re.fullmatch(r"(?i)on .+ wrote:[ \t]*", line) and marked(after):
            continue
        marks = re.match(r"(?:[ \t]*>)*", line)[0]
        level = marks.count(">")
        body = line if not level else line[len(marks) :].removeprefix(" ")
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    own = "\n".join("\n".join(b) for n, b in runs if not n)
    if len(runs) > 1:
        own = re.sub(r"\n{3,}", "\n\n", own).strip(" \t\n")
    return own, [(n, "\n".join(b)) for n, b in runs if n and plain("\n".join(b))]


def brute(rows):
    """What format_chat returns, message by message."""
    talks, out = {}, []
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((LOW if turn is None else turn, role or "unknown", *parse(text or "")))
    for conv, said in talks.items():
        first, up, seen = {}, {}, []
        for turn, _, own, _ in said:
            if plain(own):
                for unit in {plain(own), *map(plain, own.split("\n"))} - {""}:
                    first[unit] = min(first.get(unit, turn), turn)
        for turn, role, own, quotes in said:
            lost, origins = [], []
            for level, quoted in quotes:
                score = {}
                for n, unit in enumerate([plain(quoted), *filter(None, map(plain, quoted.split("\n")))]):
                    if first.get(unit, turn) < turn:
                        whole, lines = score.get(first[unit], (False, 0))
                        score[first[unit]] = (whole or n == 0, lines + 1)
                if score:
                    origins.append((-level, max(score, key=lambda o: (*score[o], o))))
                else:
                    lost.append(quoted)
            reply = max(origins)[1] if origins else None
            if reply is not None:
                up[turn] = max(up.get(turn, reply), reply)
            seen.append((turn, role, own, reply, len(quotes), len(origins), lost))

        def root(turn):
            while turn in up:
                turn = up[turn]
            return turn

        show = lambda t: None if t == LOW else t
        for k, (turn, role, own, reply, n, linked, lost) in enumerate(sorted(seen, key=lambda s: (root(s[0]), s[0], s[1]))):
            out.append((conv, k, show(turn), role, show(root(turn)), show(reply), n, linked, own, lost))
    return sorted(out, key=str)


def threads(rng):
    """Conversations whose messages quote earlier ones, whole or in part, nested, respaced and in other case, or nobody."""
    rows, vocabulary = [], ["alpha", "beta", "Gamma", "delta x", "one  two", "", "eins zwei drei", "é à"]
    for conv in [None, *range(12)]:
        talk, turn = [], rng.randint(-4, 1)
        for _ in range(rng.randint(1, 14)):
            lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 3))]
            for _ in range(rng.randint(0, 2)):
                quoted = (rng.choice(talk)[3] or "" if talk and rng.random() < 0.85 else "nobody said this").split("\n")
                lo = rng.randrange(len(quoted))
                quoted = quoted if rng.random() < 0.5 else quoted[lo : lo + 2]
                change = rng.choice([str, str.upper, lambda x: x.replace(" ", " \t")])
                quoted = [rng.choice([">", "> ", " > "]) + change(x) for x in quoted]
                at = rng.randint(0, len(lines))
                lines[at:at] = rng.choice([[], ["On Monday Bob wrote:"], ["on Tuesday, she wrote: ", ""]]) + quoted
            row = (conv, None if not talk and rng.random() < 0.3 else turn, rng.choice(["user", "bot", None]), rng.choice(["\n".join(lines)] * 9 + [None]))
            talk += [row] * rng.choice([1, 1, 1, 1, 2])
            turn += rng.randint(1, 3)
        rows += talk
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_threads_against_brute_force(spark, seed):
    rows = threads(random.Random(seed))
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    names = ("conv_id", "position", "turn", "role", "root_turn", "reply_to", "n_quotes", "n_linked", "text", "unlinked")
    got = sorted((tuple(r[n] for n in names) for r in chat.format_chat(d).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert sum(w[7] for w in want) > 30 and any(w[9] for w in want)


def test_query_against_brute_force(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    names = ("conv_id", "position", "turn", "role", "root_turn", "reply_to", "n_quotes", "n_linked")
    got = [(*(r[n] for n in names), r["n_unlinked"], r["chat"]) for r in queries.op5_chat(spark, sf).collect()]
    want = [(*w[:8], len(w[9]), f"<|{w[3]}|>\n{w[8]}\n") for w in brute(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_message_of_many_lines(spark):
    """Alternating levels: a fold that copies all runs for each line would take minutes."""
    text = "\n".join(f"> q{k}\nanswer {k}" for k in range(100_000))
    d = spark.createDataFrame([(1, 0, "user", text)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.parsed(d).select(F.size("quotes").alias("n"), F.length("own").alias("own")).first()
    assert r["n"] == 100_000 and r["own"] == len("\n".join(f"answer {k}" for k in range(100_000)))


NAMES = ("conv_id", "position", "turn", "role", "root_turn", "reply_to", "n_quotes", "n_linked", "text", "unlinked")
MANY = 1_000_000


def formatted(spark, rows):
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return sorted((tuple(r[n] for n in NAMES) for r in chat.format_chat(d).collect()), key=str)


def test_any_turn_and_conversation(spark):
    """Turns and conversations at both ends of BIGINT, microseconds, missing ones in numbers, and turns that only look missing."""
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(c, t, "u", f"said at {t}" if t != high else f"> said at {low}\nend") for c in (low, high, None, 0) for t in (low, -(1 << 40), 0, 1 << 42, 1_700_000_000_000_000, high)]
    rows += [(0, None, f"u{k:02}", f"no turn {k}") for k in range(40)] + [(0, None, "u", "> said at 0\nno turn")] + [(low, None, "u", "same")] * 20
    assert formatted(spark, rows) == brute(rows)


def test_deep_quotes_and_blank_lines(spark):
    """A million signs in a line, and a million blank lines after an attribution, with and without a quote after them."""
    rows = [
        (1, 0, "u", "the first words"),
        (1, 1, "u", ">" * MANY + " the first words\nown"),
        (1, 2, "u", "On Monday Bob wrote:\n" + "\n" * MANY + "> the first words\nown two"),
        (1, 3, "u", "> the first words\nOn Monday Bob wrote:" + " " * MANY + "\n" * MANY + "own three"),
        (1, 4, "u", "> the first words\nown" + " " * MANY + "four"),
        (1, 5, "u", "> > " * (MANY // 4) + "deep"),
    ]
    assert formatted(spark, rows) == brute(rows)
