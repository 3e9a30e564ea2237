"""Template texts and paths of a host follow from all of its pages, whichever a few would show."""

from pyspark.sql import functions as F

from tidemark.llm import html

LINE = "Read it all, every day, on our pages."


def page(k, line):
    shared = f"<p>{LINE}</p>" if line else ""
    body = "".join(f"<p>Story {k} goes on, part {j}, at some length and with a word or two more.</p>" for j in range(5))
    return f"<html><body><div class='x1'>Menu</div><div class='x2'><h1>Title {k}</h1>{shared}{body}</div></body></html>"


def test_template_texts_are_found_where_the_first_pages_lack_them(spark):
    made = [page(k, False) for k in range(400)]
    by = spark.createDataFrame([(m,) for m in made], "html string").select("html", F.xxhash64("html").alias("copy")).orderBy("copy").collect()
    few = {r.html for r in by[:12]}
    # The twelve pages of the least hashes lack the line; every other page that keeps a larger hash has it.
    bound, with_line = by[11]["copy"], spark.createDataFrame([(k, page(k, True)) for k in range(400)], "k long, html string").select("k", "html", F.xxhash64("html").alias("copy"))
    rows = [(k, "http://one/", m) for k, m in enumerate(made) if m in few] + [(r.k, "http://one/", r.html) for r in with_line.filter(F.col("copy") > bound).collect() if made[r.k] not in few][:60]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 72 and not any(LINE in t for t in got.values())
    assert all(t.startswith(f"Title {k}\n\nStory {k} goes on, part 0") and t.count("\n\n") == 5 for k, t in got.items())


def test_wrappers_equal_those_of_all_pages_at_once(spark):
    rows = [("a", page(k, k % 10 < 7)) for k in range(30)] + [("b", page(k, k % 10 < 5)) for k in range(30)] + [("c", page(0, True))] * 5 + [("d", "")]
    df = spark.createDataFrame([*rows, *rows[:20]], "host string, html string").withColumn("copy", F.xxhash64("html"))
    order = {h: [r.html for r in df.filter(F.col("host") == h).select("html", "copy").distinct().orderBy("copy").collect()] for h in "abcd"}
    got = {r.host: {"path": r.path, "template": r.template} for r in html.wrappers(df).collect()}
    assert got == {h: html.induce(p) for h, p in order.items()}
    assert [len(got[h]["template"]) for h in "abcd"] == [1, 0, 0, 0]
