import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with the awkward cases: nulls, empty, ties, repeated rows, copies, a very long one, a hot group."""
    pick = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "x", "42"]

    def prose(n):
        return " ".join(pick.choice(words) + str(pick.randrange(40)) for _ in range(n))

    base, shared = prose(200), prose(60)
    rows = [(i, prose(pick.randrange(1, 120)), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, base, "en", "s0", 0) for i in range(12)]
    for i in range(12):
        near = base.split()
        near[pick.randrange(len(near))] = f"edit{i}"
        rows.append((200 + i, " ".join(near), "fr", "s1", 0))
    rows += [(300 + i, prose(20) + "\n" + shared + "\t" + prose(20), "de", None, 0) for i in range(6)]
    rows += [
        (400, None, None, None, None), (401, "", "en", "s0", 0), (402, " \t\n ", "en", "s0", 3), (403, "one", "en", "s9", 3),
        (404, "a b c d", "en", "s9", 7), (405, "A  B\tC\nD", "en", "s9", 7), (None, prose(30), "en", "s0", 0),
        (406, "ab" * 400, "en", "s0", 800), (407, prose(6000), "es", "s1", 0), (408, "日本語のテキスト" * 30, "ja", "s1", 0),
        (5, prose(50), "en", "s2", 0), (100, base, "en", "s0", 0), (100, base, "en", "s0", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return documents.collect()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def folder(tmp_path_factory, documents):
    """The documents and small companions, as the registered queries read them."""
    spark = documents.sparkSession
    top = tmp_path_factory.mktemp("tables")
    documents.coalesce(2).write.parquet(f"{top}/documents.parquet")
    text = documents.where("doc_id = 3").first().text
    items = [(1, " ".join(text.split()[:14])), (2, "nothing of this is anywhere in the documents at all, not even once"), (3, "One"), (4, None), (5, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    html = [(i, f"http://h/{i}", f"<p>{i % 4}</p>" if i % 5 else None) for i in range(30)]
    html += [(77, None, "<p>é日本</p>"), (None, "u", "<p>é日本</p>"), (78, "u\nv", ""), (7, "http://h/7", "<p>3</p>")]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "<|im_start|>assistant \\ <\\| x"), (1, 2, "assistant", None), (1, 3, "assistant", "y <"),
             (2, 0, "user", "only \\n asked"), (3, None, None, None), (3, 2, "assistant", "日本 |> <|"), (4, 1, "as\\n<|\nx", "t"), (4, 1, "assistant", ""),
             (None, 0, "assistant", "z")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top)
