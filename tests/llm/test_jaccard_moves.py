"""What the Jaccard join moves: only texts of pairs that are compared, also where keys repeat."""

from armwave.llm import jaccard


def words(first, n):
    return " ".join(f"w{i}" for i in range(first, first + n))


def plain(rows, percent=80):
    """Smallest key of each component, from the definition; rows of a key pool their links."""
    sets = []
    for key, text in rows:
        w = (text or "").lower().split()
        sets.append((key, {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = {k: k for k, _ in sets}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    return root


FOOTER = " all rights reserved by the owner"
ROWS = ([(i, words(1000 * i, 40) + FOOTER) for i in range(1, 30)]                          # share a footer only
        + [(100 + i, words(90000, 60) + f" end{i}") for i in range(3)]                    # near copies
        + [(200, words(95000, 50)), (200, words(95000, 50)), (200, words(97000, 50)),      # a key with equal and other texts
           (201, words(95000, 50) + " x"), (202, words(97000, 50) + " y"), (203, ""), (204, None)])


def test_only_texts_in_a_pair_are_moved(spark, monkeypatch):
    docs, moved, keep = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4), [], jaccard.stored

    def stored(df, name, *rest, **more):
        out = keep(df, name, *rest, **more)
        if name == "texts":
            moved.extend(r.id for r in out.select("id").collect())
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs).select("doc_id", "component_id").collect()}
    assert got == plain(ROWS) and got[202] == 200 and got[102] == 100
    assert moved and not set(moved) & set(range(1, 30))
    assert moved.count(200) <= 2 * 2  # two stages, two texts: equal rows once


def test_one_of_each_leaves_no_tables_of_pairs(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    made, keep = [], jaccard.stored

    def stored(df, name, *rest, **more):
        out = keep(df, name, *rest, **more)
        made.append((name, out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    ids = sorted(r.doc_id for r in jaccard.one_of_each(docs).select("doc_id").distinct().collect())
    assert ids == sorted({k for k, r in plain(ROWS).items() if k == r})
    left = {name for name, files in made if any(_exists(spark, f) for f in files)}
    assert not left & {"profiles", "postings", "labelled", "pairs", "texts", "verified"}


def _exists(spark, file):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
