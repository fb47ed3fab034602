import random
import re
import textwrap
import time

from pyspark.sql import functions as F

from tessera.llm.quotes import ANNOUNCES, link_quotes

ROWS = [
    (1, 0, "u", "Hello there.\nSecond line of mine.\n\nAnother para that\nwraps here."),
    (1, 1, "a", "On Monday X wrote:\n> Hello there.\n> Second  LINE of mine.\n\nI agree."),
    (1, 2, "u", "> > Hello there.\n> I agree.\nMe too."),
    (1, 3, "a", ">> another para that wraps here.\nok"),
    (1, 4, "u", None),
    (1, 5, "u", "> never said\nhm"),
    (1, 6, "u", "> Me too.\nEnd"),
    (None, 1, "u", "> I agree."),
    (2, None, "u", "> x"),
    (2, 1, "u", "> I agree."),
    (3, 0, "u", "same words"),
    (3, 1, "a", "same words"),
    (3, 2, "u", "> same words\nyes"),
    (3, 2, "u", "> same words\nyes"),
]


def made(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit(1), "source": F.lit("s"), "lines": F.lit("l")})
    return link_quotes(df).collect()


def test_links(spark):
    by = {(r.conv_id, r.turn): r for r in made(spark)}
    links = {k: (r.reply_to, r.thread, r.depth) for k, r in by.items()}
    assert links[1, 0] == (None, 0, 0)
    assert links[1, 1] == (0, 0, 1)
    assert links[1, 2] == (1, 0, 2)
    assert links[1, 3] == (0, 0, 1)
    assert links[1, 5] == (None, 5, 0)
    assert links[1, 6] == (2, 0, 3)
    assert links[2, 1] == (None, 1, 0)
    assert links[3, 2] == (0, 0, 1)
    assert links[None, 1] == (None, 1, 0)
    assert (by[1, 2].n_quotes, by[1, 2].n_linked, by[1, 2].quote_depth) == (2, 2, 2)


def test_texts_without_quotes(spark):
    rows = made(spark)
    assert len(rows) == len(ROWS)
    by = {(r.conv_id, r.turn): r.text for r in rows}
    assert by[1, 0] == ROWS[0][3]
    assert (by[1, 1], by[1, 2], by[1, 4], by[1, 5]) == ("I agree.", "Me too.", "", "hm")


def test_parents_come_first(spark):
    order = sorted((r for r in made(spark) if r.conv_id == 1), key=lambda r: (r.thread, r.turn))
    seen = set()
    for r in order:
        assert r.reply_to is None or r.reply_to in seen
        seen.add(r.turn)


def test_no_messages(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert link_quotes(empty).count() == 0


def level_and_body(line):
    marks = re.match(r"(?:[ \t]*>)*", line)[0]
    return marks.count(">"), re.sub(r"\r$", "", line[len(marks) :].removeprefix(" ") if marks else line) if marks else line


def norm(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def model(messages):
    """(conv, turn) -> (n_quotes, n_linked, depth of quotes, reply_to, thread, depth, position), message by message."""
    parsed = {}
    for conv, turn, _, text in messages:
        lines = [level_and_body(x) for x in (text or "").split("\n")]
        quoting = any(k for k, _ in lines)
        runs, before = [], None
        for k, body in lines:
            if not body.strip(" "):
                before = None
                continue
            if before == k:
                runs[-1][1].append(body)
            else:
                runs.append((k, [body]))
            before = k
        passages = [(k, norm(" ".join(b))) for k, b in runs]
        own = [b for k, b in lines if k == 0 and not (quoting and re.search(ANNOUNCES, b))]
        told = {t for k, t in passages if k == 0} | {norm(b) for b in own} | {norm("\n".join(own))}
        parsed[conv, turn] = (lines, [p for p in passages if p[0] and p[1]], told, quoting)
    out = {}
    for conv in {c for c, *_ in messages}:
        turns = sorted(t for c, t in parsed if c == conv)
        first = {}
        for t in turns:
            for h in parsed[conv, t][2]:
                first.setdefault(h, t)
        reply, linked = {}, {}
        for t in turns:
            lines, passages, _, quoting = parsed[conv, t]
            score = {}
            for k, text, weight in [(k, x, 2) for k, x in passages] + [(k, norm(b), 1) for k, b in lines if k]:
                if text and first.get(text, t) < t:
                    score[k, first[text]] = score.get((k, first[text]), 0) + weight * len(text)
                    linked[t] = linked.get(t, 0) + (weight == 2)
            if score:
                reply[t] = max((-k, n, s) for (k, s), n in score.items())[2]

        def chain(t):
            return (t, 0) if t not in reply else (lambda r: (r[0], r[1] + 1))(chain(reply[t]))

        order = sorted(turns, key=lambda t: (chain(t)[0], t))
        for t in turns:
            lines, passages, _, _ = parsed[conv, t]
            out[conv, t] = (len(passages), linked.get(t, 0), max(k for k, _ in lines), reply.get(t), *chain(t), order.index(t))
    return out


def test_against_a_model_message_by_message(spark):
    rng = random.Random(11)
    sentences = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta".split(), k=rng.randint(4, 9))) for _ in range(1_500)]
    messages = []
    for conv in range(12):
        sent = []
        for turn in range(rng.randint(2, 25)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if not sent:
                    break
                lines += [rng.choice(["", "Am 3. schrieb X:", "On Monday Y wrote:"])] * rng.randint(0, 1)
                mark = rng.choice(["> ", ">", " >\t"])
                lines += [mark + x for x in rng.choice(sent[-3:]).split("\n")[: rng.randint(1, 8)]]
                lines += [rng.choice(["", "  ", ">", "thanks\r"])]
            lines += [x.title() if rng.random() < 0.1 else x for x in rng.sample(sentences, rng.randint(1, 4))]
            sent.append("\n".join(lines))
            messages.append((conv, turn, "u", sent[-1]))
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.quote_depth, r.reply_to, r.thread, r.depth, r.position) for r in link_quotes(df).collect()}
    want = model(messages)
    assert sum(v[3] is not None for v in want.values()) > 60 and max(v[5] for v in want.values()) > 3
    assert got == want


def test_many_marks_and_many_lines(spark):
    deep = ">" * 20_000 + " deep\n" + "> " * 20_000 + "x"
    told = "\n".join(f"line {i} of a long message" for i in range(8_000))
    quoted = "\n".join(f"> line {i} of a long message" for i in range(8_000)) + "\nI agree"
    rows = [(1, 0, "u", told), (1, 1, "a", quoted), (1, 2, "u", deep), (1, 3, "u", "On " + "schrieb " * 50_000), (1, 4, "u", ">" * 1_000_000), (1, 5, "u", ("> a\n\n") * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    link_quotes(df.limit(1)).collect()
    began = time.perf_counter()
    by = {r.turn: r for r in link_quotes(df).collect()}
    assert time.perf_counter() - began < 20
    assert (by[1].reply_to, by[1].text, by[1].n_quotes, by[1].n_linked) == (0, "I agree", 1, 1)
    assert by[2].quote_depth == 20_000 and by[4].quote_depth == 1_000_000 and by[5].n_quotes == 20_000


def test_positions_are_gapless(spark):
    rows = [(c, t, "u", f"> m{c} {t - 2}\nm{c} {t}") for c in range(3) for t in range(400)] + [(None, 1, "u", "x"), (9, None, "u", "y"), (9, 4, "u", "z"), (9, 4, "u", "z")]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in range(3):
        own = {r.turn: r for r in got if r.conv_id == c}
        assert sorted(r.position for r in own.values()) == list(range(400))
        assert all(r.reply_to is None or own[r.reply_to].position < r.position for r in own.values())
        assert [r.turn for r in sorted(own.values(), key=lambda r: r.position)] == [*range(0, 400, 2), *range(1, 400, 2)]
    assert [r.position for r in got if r.conv_id is None or r.turn is None] == [None, None]
    assert [r.position for r in got if r.conv_id == 9 and r.turn == 4] == [0, 0]


def test_announcements_of_any_length(spark):
    long = "On Monday " + "X, " * 600 + "wrote:"
    rows = [(1, 0, "u", "Hello there."), (1, 1, "a", long + "\n> Hello there.\nI agree."), (1, 2, "u", "> I agree.\n" + long.replace("wrote", "said") + "\nok")]
    rows += [(2, k, "u", f"On {x}\n> said\nok") for k, x in enumerate(["schrieb " * 50_000, "schrieb : " * 50_000 + "x", " " * 500_000 + "x", "wrote" + " " * 500_000 + "x:", "\u0301" * 500_000])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    by = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    assert time.perf_counter() - began < 20
    assert (by[1, 1].text, by[1, 1].reply_to) == ("I agree.", 0)
    assert by[1, 2].reply_to == 1 and by[1, 2].text.endswith("said:\nok")
    assert all(by[2, k].text.endswith("ok") and by[2, k].n_linked == 0 for k in range(5))


def test_own_passages_end_at_announcements_and_white_space(spark):
    rows = [
        (1, 0, "u", "Hello there."),
        (1, 1, "a", "First of all.\n\nI agree with\nthis plan.\nOn Monday X wrote:\n> Hello there."),
        (1, 2, "u", "> I agree with this\n> plan.\nok"),
        (1, 3, "u", "> I agree with this\n> plan. On Monday X\n> wrote:\n> > Hello there.\nok"),
        (2, 0, "u", "One line\r\nand another.\r\n\r\nThen a third\r\none."),
        (2, 1, "u", "> One line and\n> another.\nyes"),
        (3, 0, "u", "One line\nand another.\n \t\nThen a third\none."),
        (3, 1, "u", "> Then a third one.\nyes"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked) for r in link_quotes(df).collect()}
    assert got == {(1, 0): (None, 0, 0), (1, 1): (0, 1, 1), (1, 2): (1, 1, 1), (1, 3): (1, 2, 2), (2, 0): (None, 0, 0), (2, 1): (0, 1, 1), (3, 0): (None, 0, 0), (3, 1): (0, 1, 1)}


def test_each_rewrapped_passage_is_found(spark):
    rng = random.Random(5)
    messages, want = [], {}
    for conv in range(15):
        sent = []
        for turn in range(12):
            end = rng.choice(["\n", "\r\n"])
            own = [" ".join(f"w{conv}x{turn}x{k}x{i}" for i in range(rng.randint(5, 30))) for k in range(rng.randint(1, 3))]
            blocks = [rng.choice(["", " \t"]).join([end, end]).join(end.join(textwrap.wrap(p, rng.randint(30, 60))) for p in own)]
            want[conv, turn] = (None, 0, 0)
            if sent and rng.random() < 0.8:
                source = rng.randrange(turn)
                quote = end.join("> " + x for x in textwrap.wrap(rng.choice(sent[source]), rng.randint(30, 60)))
                blocks += [end, rng.choice(["", "Am 3. schrieb X:" + end, "On Monday Y wrote:" + end]), quote]
                want[conv, turn] = (source, 1, 1)
            messages.append((conv, turn, "u", "".join(blocks)))
            sent.append(own)
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked) for r in link_quotes(df).collect()} == want
