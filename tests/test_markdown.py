import random
import re

from quillspark.operators import markdown


def parse(spark, *files):
    df = spark.createDataFrame(list(files), "file string, text string")
    return [r.asDict() for r in markdown.sections(df).orderBy("file", "pos").collect()]


def test_sections_slugs_and_paths(spark):
    got = parse(spark, ("garden.md", "# Garden Notes\nlost\n## Watering\nat dawn\n### Roses & Co.\ndeep\n## Watering\nat dusk\n#### Roses & Co.\nsparse\n"))
    assert [r["id"] for r in got] == [f"garden.md#{x}" for x in ("watering", "roses-co", "watering-2", "roses-co-2")]
    assert [r["heading_path"][1:] for r in got] == [["Watering"], ["Watering", "Roses & Co."], ["Watering"], ["Watering", "Roses & Co."]]
    assert all(r["heading_path"][0] == "Garden Notes" for r in got) and [r["content"] for r in got] == ["at dawn", "deep", "at dusk", "sparse"]


def test_empty_sections_take_no_number(spark):
    got = parse(spark, ("a.md", "## A\n\n## A\nx\n## A\ny\n## ##\nz"))
    assert [r["id"] for r in got] == ["a.md#a", "a.md#a-2", "a.md#section"]


def test_level_one_ends_a_section_and_heads_later_paths(spark):
    got = parse(spark, ("a.md", "before\n## A\nx\n# T\nlost\n### B\r\ny\n"))
    assert [(r["heading_path"], r["content"]) for r in got] == [(["A"], "x"), (["T", "B"], "y")]


def brute(text):
    out, stack, cur = [], {}, None
    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
        if m:
            level, head = len(m[1]), m[2].strip().strip("#").strip()
            stack = {k: v for k, v in stack.items() if k < level} | {level: head}
            cur = None
            if level > 1:
                cur = ([stack[k] for k in sorted(stack)], [])
                out.append(cur)
        elif cur:
            cur[1].append(line)
    return [(p, "\n".join(b).strip()) for p, b in out if "\n".join(b).strip()]


def test_heading_stack_on_random_documents(spark):
    pick = random.Random(3)
    texts = ["\n".join("#" * pick.randint(1, 7) + " h" + str(pick.randint(0, 5)) if pick.random() < 0.5 else pick.choice(["text", "", "  ", "#no", "####### seven"]) for _ in range(pick.randint(0, 30))) for _ in range(60)]
    got = parse(spark, *((f"{k:03}.md", t) for k, t in enumerate(texts)))
    for k, t in enumerate(texts):
        assert [(r["heading_path"], r["content"]) for r in got if r["file"] == f"{k:03}.md"] == brute(t)
