"""Who may see what, and changes to the tables of documents, chunks and workspaces.

Tables are Parquet snapshots, so a change is a function from the old snapshot to the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.functions import understand as un
from lodestone.operators.containing import by_scope, containing
from lodestone.session import checkpoint_dir

NO_CONTENT = "No text content found in document"
STUCK = "Processing stuck (server restarted?)"
TIMED_OUT = "Processing timed out"
NEW_WORKSPACE = "My workspace"


# --- access ------------------------------------------------------------------------------


def same(a: Column, b: Column) -> Column:
    """Equality that is false rather than unknown for missing values."""
    return F.coalesce(a == b, F.lit(False))


def tenant_sees_document(tenant_ws: Column, admin: Column, doc_ws: Column) -> Column:
    """Documents without a workspace are for tenants without one."""
    return admin | (doc_ws.isNull() & tenant_ws.isNull()) | same(doc_ws, tenant_ws)


def tenant_sees_workspace(tenant_ws: Column, admin: Column, target: Column) -> Column:
    return admin | same(tenant_ws, target)


def document_access(requests: DataFrame, documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Add `allowed` to requests (user_id, workspace_id, is_admin, document_id)."""
    docs = documents.select(
        "document_id", F.col("workspace_id").alias("_ws"), F.col("user_id").alias("_owner"), F.lit(True).alias("_known")
    )
    owners = workspaces.select(F.col("id").alias("_ws"), F.col("user_id").alias("_ws_owner"))
    user, owner = F.col("user_id"), F.col("_owner")
    foreign = F.coalesce(owner != user, F.lit(False))
    unassigned = F.col("_ws").isNull() & user.isNotNull() & (owner.isNull() | same(owner, user))
    allowed = ~foreign & (
        tenant_sees_document(F.col("workspace_id"), F.col("is_admin"), F.col("_ws"))
        | unassigned
        | same(F.col("_ws_owner"), user)
    )
    joined = requests.join(docs, "document_id", "left").join(owners, "_ws", "left")
    return joined.select(*requests.columns, (F.coalesce("_known", F.lit(False)) & allowed).alias("allowed"))


def workspace_access(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Add `allowed` to requests (user_id, workspace_id, is_admin, target)."""
    owners = workspaces.select(F.col("id").alias("target"), F.col("user_id").alias("_owner"))
    allowed = tenant_sees_workspace(F.col("workspace_id"), F.col("is_admin"), F.col("target")) | same(
        F.col("_owner"), F.col("user_id")
    )
    return requests.join(owners, "target", "left").select(*requests.columns, allowed.alias("allowed"))


def document_filter(workspace_id: str | None, admin: bool = False, column: str = "workspace_id") -> Column:
    """Condition that narrows documents to a tenant; none for admins and tenants without a workspace."""
    return F.lit(True) if admin or workspace_id is None else F.col(column) == workspace_id


def accessible_workspaces(workspaces: DataFrame, workspace_id: str | None, admin: bool = False) -> DataFrame:
    if admin:
        return workspaces.select("id")
    return workspaces.select("id").where(F.lit(workspace_id is not None) & (F.col("id") == F.lit(workspace_id)))


def list_documents(documents: DataFrame, workspaces: DataFrame, user_id: str | None, workspace_id: str | None = None):
    """A user's documents, newest first: own or unowned ones, in a workspace or in all owned ones."""
    df = documents
    if user_id:
        df = df.where(F.col("user_id").isNull() | (F.col("user_id") == user_id))
    if workspace_id:
        df = df.where(F.col("workspace_id") == workspace_id)
    elif user_id:
        owned = workspaces.where(F.col("user_id") == user_id).select(F.col("id").alias("workspace_id"))
        df = df.where("workspace_id IS NULL").unionByName(df.join(owned, "workspace_id", "left_semi").select(df.columns))
    else:
        df = df.where("workspace_id IS NULL")
    return df.orderBy(F.desc("created_at"), "document_id")


def listings(requests: DataFrame, documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """`list_documents` for a table (user_id, workspace_id): documents with the request as scope_user_id, scope_workspace_id.

    Equal requests count once. Joins are by workspace and owner, where an unowned document has the owner "none".
    """
    user, ws = "scope_user_id", "scope_workspace_id"
    asked = requests.select(F.col("user_id").alias(user), F.col("workspace_id").alias(ws)).distinct()
    owned = workspaces.where("user_id IS NOT NULL").select(F.col("user_id").alias(user), F.col("id").alias("_ws"))
    open_ = asked.where(f"{ws} IS NULL")
    places = (
        asked.where(f"{ws} IS NOT NULL").withColumn("_ws", F.col(ws))
        .unionByName(open_.withColumn("_ws", F.lit(None).cast("string")))
        .unionByName(open_.join(owned, user).select(user, ws, "_ws"))
    )
    known = places.where(f"{user} IS NOT NULL")
    own = known.withColumn("_owner", F.col(user)).unionByName(known.withColumn("_owner", F.lit(None).cast("string")))
    in_place = F.col("_ws").eqNullSafe(documents["workspace_id"])
    by_owner = documents.join(own, in_place & F.col("_owner").eqNullSafe(documents["user_id"]))
    anyone = documents.join(places.where(f"{user} IS NULL"), in_place)
    columns = [user, ws, *documents.columns]
    return by_owner.select(*columns).unionByName(anyone.select(*columns))


def name_hits(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """`search_by_name` for a table (workspace_id, term): pairs (workspace_id, term in lower case, document_id)."""
    return containing(requests, documents, ["document_id"], ["workspace_id"], "name")


def ready_in(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Ready documents of every different workspace_id of the requests; a null one asks for all."""
    return by_scope(requests, documents.where("status = 'ready'"), ["workspace_id"])


def search_by_name(documents: DataFrame, term: str, workspace_id: str | None) -> DataFrame:
    """Documents of a workspace by part of their name; none without a workspace."""
    if not workspace_id:
        return documents.where(F.lit(False))
    return documents.where((F.col("workspace_id") == workspace_id) & F.lower("name").contains(term.lower()))


def ready_documents(documents: DataFrame, workspace_id: str | None = None) -> DataFrame:
    return documents.where("status = 'ready'").where(document_filter(workspace_id))


def resolve_workspace(uploads: DataFrame, users: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspace of an upload: the given one, the user's, the tenant's, the default, any owned one, else a new one."""
    first_owned = workspaces.groupBy("user_id").agg(F.min("id").alias("_owned"))
    defaults = users.select("user_id", F.col("default_workspace_id").alias("_default"))
    own = F.when(F.col("user_id").isNotNull(), F.coalesce("_default", "_owned", F.lit(NEW_WORKSPACE)))
    joined = uploads.join(defaults, "user_id", "left").join(first_owned, "user_id", "left")
    return joined.select(
        *uploads.columns, F.coalesce("given_ws", F.when(F.col("user_id").isNotNull(), F.col("user_ws")), "tenant_ws", own).alias("resolved")
    )


def check_names(names: DataFrame, reserved: DataFrame) -> DataFrame:
    """Names (.., slug) with the first problem of each: form, or already taken."""
    taken = reserved.select("slug").distinct().withColumn("_taken", F.lit(True))
    return names.join(taken, "slug", "left").select(
        *names.columns,
        F.coalesce(un.slug_error(F.col("slug")), F.when(F.col("_taken"), "reserved")).alias("problem"),
    )


def resolve_skills(requests: DataFrame, builtin: DataFrame, own: DataFrame) -> DataFrame:
    """Instruction of a requested skill: the built-in of that name, else the user's own, else none."""
    b = builtin.select(F.col("name").alias("skill"), F.col("action").alias("_b"))
    o = own.select(F.col("name").alias("skill"), "user_id", F.col("action").alias("_o"))
    return requests.join(b, "skill", "left").join(o, ["skill", "user_id"], "left").select(
        *requests.columns, F.coalesce("_b", "_o").alias("instruction")
    )


# --- snapshots ---------------------------------------------------------------------------


def upsert_documents(existing: DataFrame, incoming: DataFrame, update: bool = True) -> DataFrame:
    """Insert documents; on a known id replace count, status and time, or keep what is there."""
    fields = ["chunk_count", "status", "updated_at"]
    old = existing.select("document_id", *[F.col(c).alias(f"_{c}") for c in fields])
    pick = (lambda c: F.coalesce(c, f"_{c}")) if update else (lambda c: F.coalesce(f"_{c}", c))
    return incoming.select("document_id", *fields).join(old, "document_id", "full_outer").select(
        "document_id", *[pick(c).alias(c) for c in fields]
    )


def replace_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All chunks of the incoming documents are replaced."""
    kept = existing.join(incoming.select("document_id").distinct(), "document_id", "left_anti")
    return kept.select(incoming.columns).unionByName(incoming)


def delete_documents(documents: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = doomed.select("document_id").distinct()
    return documents.join(ids, "document_id", "left_anti"), chunks.join(ids, "document_id", "left_anti")


def delete_workspaces(workspaces, users, documents, chunks, doomed):
    """Snapshots (workspaces, users, documents, chunks) without the doomed workspaces.

    A workspace called like the default one, or in use as its owner's workspace, is protected.
    """
    gone = doomed.select("id").join(workspaces, "id").where(~same(F.col("name"), F.lit(NEW_WORKSPACE)))
    current = users.select("user_id", F.col("current_workspace_id").alias("_cur"))
    gone = gone.join(current, "user_id", "left").where(~same(F.col("_cur"), F.col("id"))).select("id").distinct()
    doc_ids = documents.join(gone, documents["workspace_id"] == gone["id"], "left_semi").select("document_id")
    kept_docs, kept_chunks = delete_documents(documents, chunks, doc_ids)
    mark = gone.select(F.col("id").alias("default_workspace_id"), F.lit(True).alias("_gone"))
    new_users = users.join(mark, "default_workspace_id", "left").select(
        *[
            F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "default_workspace_id" else F.col(c)
            for c in users.columns
        ]
    )
    return workspaces.join(gone, "id", "left_anti"), new_users, kept_docs, kept_chunks


def purge(documents: DataFrame, names: list[str] | None = None, status: str = "error") -> DataFrame:
    """Documents without those of the given names, or without those in a status."""
    return documents.where(~(F.col("name").isin(names) if names else F.col("status") == status))


def finalize_status(documents: DataFrame, chunks: DataFrame, as_of=None, limit_seconds: int = 300) -> DataFrame:
    """Outcome of an ingest run: chunk counts, errors and time-outs.

    Counts include chunks that were not embedded. A document with a message failed with it;
    `started_at` with `as_of` applies the processing time limit.
    """
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("_n"))
    df = documents.join(counts, "document_id", "left")
    failure = F.col("error_message") if "error_message" in documents.columns else F.lit(None).cast("string")
    late = F.lit(False)
    if as_of is not None and "started_at" in documents.columns:
        late = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("started_at") > limit_seconds
    problem = (
        F.when(failure.isNotNull(), F.substring(failure, 1, 500))
        .when(late & F.col("_n").isNull(), TIMED_OUT)
        .when(F.col("_n").isNull(), NO_CONTENT)
    )
    keep = [c for c in documents.columns if c not in ("status", "error_message", "chunk_count")]
    return df.select(
        *keep,
        F.when(problem.isNull(), "ready").otherwise("error").alias("status"),
        F.coalesce("_n", F.lit(0)).alias("chunk_count"),
        problem.alias("error_message"),
    )


def status_view(documents: DataFrame) -> DataFrame:
    """Count only of ready documents, message only of failed ones."""
    return documents.select(
        "document_id",
        "status",
        F.when(F.col("status") == "ready", F.col("chunk_count")).alias("chunk_count"),
        F.when(F.col("status") == "error", F.col("error_message")).alias("error"),
    )


def sweep_stuck(documents: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Documents that stay in processing for too long become errors."""
    stuck = (F.col("status") == "processing") & (
        F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("updated_at") > minutes * 60
    )
    return documents.withColumn("error_message", F.when(stuck, STUCK)).withColumn(
        "status", F.when(stuck, "error").otherwise(F.col("status"))
    )


def workspace_counts(workspaces: DataFrame, documents: DataFrame, user_id: str | None = None) -> DataFrame:
    """Workspaces, all or a user's, with the number of documents that are unowned or their owner's, empty ones included.

    Documents are counted by workspace and owner before they meet the workspaces. A workspace id occurs once.
    """
    owned = workspaces if user_id is None else workspaces.where(F.col("user_id") == user_id)
    owners = owned.select("id", F.col("user_id").alias("_owner"))
    each = documents.groupBy(F.col("workspace_id").alias("id"), F.col("user_id").alias("_by")).agg(F.count("*").alias("_k"))
    mine = each.join(owners, "id").where(F.col("_by").isNull() | same(F.col("_by"), F.col("_owner")))
    counts = mine.groupBy("id").agg(F.sum("_k").alias("_n"))
    return owned.join(counts, "id", "left").select(*workspaces.columns, F.coalesce("_n", F.lit(0)).alias("documents"))


def document_stats(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.sum("file_size").alias("total_size"),
    )


def file_size(size: Column) -> Column:
    """Steps of 1024, two decimals at most."""
    power = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    value = F.format_string("%.2f", F.round(size / F.pow(F.lit(1024), power), 2))
    number = F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")
    unit = F.element_at(F.array(*map(F.lit, ["Bytes", "KB", "MB", "GB"])), power + 1)
    return F.when(size == 0, "0 Bytes").otherwise(F.concat(number, F.lit(" "), unit))


def first_pages(pages: DataFrame, limit: int = 20) -> DataFrame:
    order = W.partitionBy("document_id").orderBy("page_number")
    return pages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def context_chunk(requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Direct chunk requests (request_id, chunk_id, workspace_id?, user_id?): found with score 1, or not_found."""
    docs = documents.select("document_id", F.col("workspace_id").alias("_ws"), F.col("user_id").alias("_user"))
    known = chunks.select("chunk_id", "document_id").join(docs, "document_id")
    ok = (
        F.col("document_id").isNotNull()
        & (F.col("workspace_id").isNull() | same(F.col("_ws"), F.col("workspace_id")))
        & (F.col("user_id").isNull() | same(F.col("_user"), F.col("user_id")))
    )
    return requests.join(known, "chunk_id", "left").select(
        "request_id",
        "chunk_id",
        F.when(ok, 1.0).alias("score"),
        F.lit("CHUNK").alias("strategy_used"),
        F.when(ok, "found").otherwise("not_found").alias("outcome"),
    )


def retrieval_outcome(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hits left inside the documents a query names, and why there are none."""
    asked = queries.select("query_id", "document_ids")
    hits = ranked.join(asked, "query_id").where(
        F.col("document_ids").isNull() | F.array_contains("document_ids", F.col("document_id"))
    )
    n = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    return asked.join(n, "query_id", "left").select(
        "query_id",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.when(F.col("hits").isNotNull(), "ok")
        .when(F.col("document_ids").isNotNull(), "no_chunks_in_scope")
        .otherwise("no_chunks")
        .alias("outcome"),
    )


def version_chain(docs: DataFrame) -> DataFrame:
    """Add root, depth and newest to documents (document_id, previous_document_id).

    Pointer doubling: after each round a document points twice as far back, so the rounds grow with the logarithm of
    the longest chain. Rounds are stored tables, and documents whose root is known are not joined again. The
    newest version is the deepest one of a root, the largest id among equals. A previous document that does not exist
    makes a root; documents that only lead into a cycle get nulls. Ids are unique and not null.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    known = docs.select(F.col("document_id").alias("_known"))
    links = docs.select("document_id", "previous_document_id").join(known, F.col("previous_document_id") == F.col("_known"), "left")
    far = F.when(F.col("_known").isNull(), 0).otherwise(1).cast("long")
    steps = stored(links.select("document_id", F.coalesce("_known", "document_id").alias("to"), far.alias("depth")), "0")
    roots = steps.where("depth = 0").select(F.col("document_id").alias("root"))
    n = steps.count()
    done, open_ = roots.select(F.col("root").alias("document_id"), "root", F.lit(0).cast("long").alias("depth")), steps.where("depth > 0")
    for turn in range(1, max(1, n).bit_length() + 1):
        known = done.select(F.col("document_id").alias("to"), "root", F.col("depth").alias("_depth"))
        ended = open_.join(known, "to").select("document_id", "root", (F.col("depth") + F.col("_depth")).alias("depth"))
        ahead = open_.select(F.col("document_id").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"))
        rest = open_.join(known, "to", "left_anti").join(ahead, "to")
        rest = rest.select("document_id", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"))
        done, open_ = done.unionByName(stored(ended, f"done{turn}")), stored(rest, f"open{turn}")
        if open_.isEmpty():
            break
    newest = done.groupBy("root").agg(F.max(F.struct("depth", "document_id"))["document_id"].alias("newest"))
    return docs.join(done, "document_id", "left").join(newest, "root", "left").select(*docs.columns, "root", "depth", "newest")
