"""Tables of requests against plain loops."""

import random

from lodestone.operators import containing as ct, conversations as cv, tenancy

USERS, SPACES = ["u1", "u2", None], ["a", "b", None]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_terms_found_by_their_rarest_gram(spark):
    rng = random.Random(4)
    letters = ["a", "b", "é", "\U0001f600", " ", "\n", "%", "_"]
    texts = [(i, rng.choice(SPACES), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 9, 200])))) for i in range(150)]
    texts += [(150, "a", None), (151, "a", "x" * 30000 + "NEEDLE" + "y" * 30000)]
    terms = [(rng.choice(SPACES), "".join(rng.choice(letters) for _ in range(n % 6))) for n in range(80)]
    terms += [("a", None), ("a", "Needle"), ("b", "Needle"), ("a", "AB"), ("a", "ab"), ("a", "zzz")]
    found = ct.containing(
        spark.createDataFrame(terms, "ws string, term string"), spark.createDataFrame(texts, "id int, ws string, text string"), ["id"], ["ws"], "text"
    )
    want = {
        (ws, term.lower(), i) for ws, term in terms for i, at, text in texts
        if None not in (ws, term, text) and ws == at and term.lower() in text.lower()
    }
    assert rows(found, "ws", "term", "id") == sorted(want, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_terms_and_texts_may_be_missing(spark):
    texts, terms = "id int, ws string, text string", "ws string, term string"
    none = ct.containing(spark.createDataFrame([], terms), spark.createDataFrame([(1, "a", "x")], texts), ["id"], ["ws"], "text")
    assert none.count() == 0
    none = ct.containing(spark.createDataFrame([("a", "")], terms), spark.createDataFrame([], texts), ["id"], ["ws"], "text")
    assert none.count() == 0


def test_listings_equal_the_single_request(spark):
    rng = random.Random(6)
    docs = [(str(i), rng.choice(SPACES), rng.choice(USERS), i) for i in range(60)]
    documents = spark.createDataFrame(docs, "document_id string, workspace_id string, user_id string, created_at int")
    workspaces = spark.createDataFrame([("a", "u1"), ("b", None), ("c", "u2")], "id string, user_id string")
    asked = [(u, w) for u in USERS + ["u9"] for w in SPACES] * 2
    got = rows(
        tenancy.listings(spark.createDataFrame(asked, "user_id string, workspace_id string"), documents, workspaces),
        "scope_user_id", "scope_workspace_id", "document_id",
    )
    want = [
        (u, w, r.document_id) for u, w in set(asked)
        for r in tenancy.list_documents(documents, workspaces, u, w).collect()
    ]
    assert got == sorted(want, key=repr)


def test_scopes_are_narrowed_by_what_they_give(spark):
    table = [(i, u, w) for i, (u, w) in enumerate([(u, w) for u in USERS for w in SPACES] * 2)]
    data = spark.createDataFrame(table, "id int, user_id string, workspace_id string")
    asked = [(u, w) for u in USERS for w in SPACES] * 3
    got = ct.by_scope(spark.createDataFrame(asked, "user_id string, workspace_id string"), data, ["user_id", "workspace_id"])
    want = [(su, sw, i) for su, sw in set(asked) for i, u, w in table if su in (None, u) and sw in (None, w)]
    assert rows(got, "scope_user_id", "scope_workspace_id", "id") == sorted(want, key=repr)


def test_conversations_found_by_title_or_any_message(spark):
    convs = spark.createDataFrame(
        [(1, "u1", "a", "Holiday plans"), (2, "u1", "b", None), (3, "u2", "a", "Other")],
        "conversation_id bigint, user_id string, workspace_id string, title string",
    )
    said = spark.createDataFrame([(1, 0, "hello"), (2, 0, "The PLANS"), (2, 1, "plans"), (3, 0, "plans")], "conversation_id bigint, turn int, content string")
    asked = [(1, "u1", None, " Plans "), (2, "u1", "b", "plans"), (3, "u1", None, "new chat"), (4, None, None, "plans"), (5, "u2", "a", ""), (6, "u2", "b", "plans")]
    found = cv.hits(spark.createDataFrame(asked, "request_id int, user_id string, workspace_id string, term string"), convs, said)
    assert rows(found, "request_id", "conversation_id") == [(1, 1), (1, 2), (2, 2), (3, 2), (5, 3)]
