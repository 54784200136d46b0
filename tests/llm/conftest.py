import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LINE = "Released under the MIT License."
PASSAGE = " ".join(f"word{i % 89}x{i * 7 % 83}" for i in range(80))


def edge_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows, copies and shared passages."""
    base = [f"w{i}q{i * i % 101}" for i in range(120)]
    near = base.copy()
    near[60] = "changed"
    far = [w if i % 9 else f"z{i}" for i, w in enumerate(base)]
    rows = [
        (1, None, "en", "b"), (2, "", "en", None), (3, " \t\n\x0b ", None, "a"), (4, "one two", "en", "a"), (5, "One  TWO", "en", "a"),
        (6, "x", None, None), (7, "123 456 ###", "de", "b"), (8, " ".join(base), "en", "a"), (9, " ".join(near).upper(), "en", "a"),
        (10, " ".join(far), "en", "c"), (11, " ".join(base), "en", "c"), (12, "a" * 5000, "en", "a"), (13, "ab " * 700 + "tail", "en", "a"),
        (14, "left side é " * 3 + PASSAGE + " right one", "fr", "a"), (15, "other head " + PASSAGE + " ñ ending", "es", "b"),
        (16, PASSAGE[50:470], "es", "b"), (17, "Ünïcode “quotes” — dash… don't I'LL <|endoftext|> İ Σς ſ 漢字 한글 é x̸.", "de", None),
        (18, f"{LINE} Some text!\nAll rights reserved\n\nAll rights reserved", "en", "a"), (19, "same line\nsame line\n\n \nsame line", "en", "a"),
        (20, "é" * 900 + "x", "fr", "a"), (21, "é" * 900 + "y", "fr", "a"), (22, "the end. " * 4000, "en", "z"), (22, "the end. " * 4000, "en", "z"),
        (None, "no key here at all", None, None), (-5, "minus five " + "k" * 130, "en", "b"), (2**40, "a far key", "de", "b"),
    ]
    return rows + [(100 + i, " ".join(base[:100] + [f"copy{i}"]), "en", "hot") for i in range(30)]


def edge_turns():
    """(conv_id, turn, role, text): nulls, unknown roles, repeated rows, equal turns, a long conversation."""
    rows = [(None, 1, "user", "No key."), (None, None, "user", None), (None, 2, None, "x"), (1, None, "assistant", "Late."), (1, 3, "user", "Late"),
            (1, 3, "user", "Late"), (1, 3, "assistant", "Tie."), (2, 1, "tool", "Run."), (2, 2, "", "Empty role!"), (2, 9, "user", " \t "), (3, 5, "system", "Only."),
            (4, 2**40, "user", "Far?"), (4, -7, "user", "Near?"), (5, 1, "user", "a." * 30000), (5, 2, "assistant", "é ñ 漢.")]
    rows += [(6, i, ["user", "assistant", "user", "system"][i * i % 4], f"turn {i % 90}" + [".", "!", "", "?"][i % 4]) for i in range(700)]
    return rows + [(7 + i, t, r, f"{t} {r}.") for i in range(60) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][i % 2:])]


def edge_pages():
    """(page_id, url, html) and what is left of it (None: not judged)."""
    text = "Words of the story, told in one line after another, with marks. It goes on for a while, and then it ends here."
    body = f"<h1>Title &amp; more</h1><p>{text}<p>A <b>bold</b>&#x6e;ess,\n two&nbsp;spaces.<br>Next line.</p>"
    menu = "<nav><ul>" + "".join(f'<li><a href="/{i}">item {i}</a>' for i in range(6)) + "</ul></nav>"
    want = f"Title & more {text} A boldness, two spaces. Next line."
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no</p>'</script></head><body>{menu}<article>{body}</article><footer>&copy; someone</footer>"
    return [
        (1, "u", None, ""), (2, None, "", ""), (3, "u", page + "</body></html>", want), (4, "u", page, want), (4, "u", page, want), (None, "u", page, want),
        (5, "u", page.replace("article>", "ARTICLE>") + "<!-- never closed <p>no</p>", want), (6, "u", page + "<p unfinished", want),
        (7, "u", "<" * 3000 + "a < b && c > d" + "<b" * 2000, None), (8, "u", "<div>" * 3000 + text, None), (9, "u", "no tag at all", None),
        (10, "u", page.replace(text, text * 500), want.replace(text, text * 500))]


def write_tables(folder, rows, labels, turns=(), pages=()):
    column = lambda table, i, kind: pa.array([r[i] for r in table], kind)
    extra = lambda table, *names: {n: pa.array([f"{n}!"] * len(table), pa.string()) for n in names}
    pq.write_table(pa.table({
        "conv_id": column(turns, 0, pa.int64()), "turn": column(turns, 1, pa.int64()), "role": column(turns, 2, pa.string()), "text": column(turns, 3, pa.string()),
        **extra(turns, "mark", "block", "audit", "cost", "_h")}), f"{folder}/conversations.parquet")
    pq.write_table(pa.table({
        "page_id": column(pages, 0, pa.int64()), "url": column(pages, 1, pa.string()), "html": column(pages, 2, pa.string()),
        **extra(pages, "text", "h", "n_chars")}), f"{folder}/pages.parquet")
    ids, texts, langs, sources = zip(*rows) if rows else ((), (), (), ())
    names = ["key", "h", "row", "size", "score", "ids", "shard", "_words", "taken", "component", "lang_pred"]
    pq.write_table(pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()),
        "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        **{n: pa.array([f"{n}!"] * len(rows), pa.string()) for n in names},
    }), f"{folder}/documents.parquet")
    pq.write_table(pa.table({
        "doc_id": pa.array([k for k, _ in labels], pa.int64()), "quality": pa.array([q for _, q in labels], pa.int64()),
        "toxic": pa.array([0] * len(labels), pa.int64())}), f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("edge"), edge_rows(), [(8, 1), (11, 1), (14, 1), (7, 0), (None, 1)], edge_turns(), edge_pages())


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], [])


@pytest.fixture(scope="session")
def edge_docs():
    return edge_rows()


@pytest.fixture(scope="session")
def result(spark, edge_dir):
    """Rows of a query over the edge table, each query run once."""
    from segspark.llm import registry

    queries, kept = registry.load()[0], {}

    def of(prefix):
        name = next(q for q in queries if q.startswith(prefix))
        if name not in kept:
            kept[name] = [r.asDict() for r in queries[name](spark, edge_dir).collect()]
        return kept[name]

    return of
