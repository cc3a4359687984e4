"""Provenance gates: file digests against manifests, configurations against saved ones, completed runs, private data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import variants as V

#: Keys that must not be published, in lower case, and what must not stand in a key or a text.
SENSITIVE_KEYS = ("api_key", "access_token", "auth_token", "password", "secret", "authorization", "private_key", "client_secret")
PRIVATE_TEXT = (
    r"[A-Za-z]:[\\/]|/(?:Users|home|tmp|mnt|private|var|srv|opt)/\S+"
    r"|ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|sk-[A-Za-z0-9]{20,}"
    r"|AKIA[0-9A-Z]{16}|-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----"
)


def _digest(path: str, unix_ends: bool, block: int = 1 << 20) -> str:
    """SHA-256 of a file in any store that Arrow reaches, block by block."""
    import hashlib

    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found, held = hashlib.sha256(), b""
    with store.open_input_stream(name) as stream:
        while data := stream.read(block):
            if unix_ends:
                data, held = held + data, b""
                if data.endswith(b"\r"):
                    data, held = data[:-1], b"\r"
                data = data.replace(b"\r\n", b"\n")
            found.update(data)
    found.update(held)
    return found.hexdigest()


def file_digests(spark: SparkSession, path: str, suffix: str = "*", unix_ends: bool = False) -> DataFrame:
    """file (path below ``path``, which is a folder), bytes, sha256 of its files whose name matches a glob.

    CRLF counts as LF in the digest if ``unix_ends``. Files are read in blocks, whatever their size.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["file"], "bytes": b["bytes"], "sha256": [_digest(p, unix_ends) for p in b["path"]]})

    listed = files.select("path", F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("file"), F.col("length").alias("bytes"))
    return listed.mapInPandas(run, "file string, bytes long, sha256 string")


def fingerprints(files: DataFrame) -> DataFrame:
    """One row: ``files``, a map of file to sha256 of all rows (file, sha256), in order of the names; for the few files of a release (any number: ``tree_fingerprint``)."""
    return files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "sha256")))).alias("files"))


def tree_fingerprint(files: DataFrame, places: int = 4) -> DataFrame:
    """n_files, fingerprint: one digest of any number of rows (file, sha256), by two levels.

    Rows are dealt to 16^places buckets by the first hex digits of the SHA-256 of their name; a bucket's digest is that of its
    ``name:sha256``, sorted and joined by commas, and the fingerprint that of the buckets' ``digits:digest``, likewise. So a task holds a bucket, and
    one row holds at most 65,536 short texts.
    """
    bucket = F.substring(F.sha2("file", 256), 1, places).alias("bucket")
    joined = lambda rows: F.sha2(F.array_join(F.array_sort(rows), ","), 256)
    buckets = files.groupBy(bucket).agg(F.count("*").alias("n"), joined(F.collect_list(F.concat("file", F.lit(":"), "sha256"))).alias("digest"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_files"), joined(F.collect_list(F.concat("bucket", F.lit(":"), "digest"))).alias("fingerprint"))


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """file, error of manifest rows (file, bytes, sha256) with an unsafe or repeated name, or without a size or digest.

    Names are relative paths in plain form: no empty, ``.`` or ``..`` part, no backslash or colon. Names that differ
    in case alone are repeated.
    """
    name = F.col("file")
    unsafe = F.coalesce(name.isNull() | (name == "") | name.rlike(r"[\\:]|^/|/$|//|(?:^|/)\.\.?(?:/|$)"), F.lit(True))
    twice = manifest.groupBy(F.lower("file").alias("key")).agg(F.count("*").alias("n"))
    rows = manifest.join(twice, F.lower("file").eqNullSafe(F.col("key")))
    error = F.when(unsafe, "unsafe name").when(F.col("n") > 1, "repeated name").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "no digest").when(~F.coalesce(F.col("bytes") >= 0, F.lit(False)), "no size")
    return rows.select("file", error.alias("error")).where("error is not null")


def pinned(revision: Column) -> Column:
    """Whether a revision is the full digest of a commit, not a name that can move."""
    return F.coalesce(revision.rlike("^[0-9a-f]{40}$"), F.lit(False))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """file, outcome of every listed or present file: 'verified', 'missing', 'unlisted', 'size' or 'digest'."""
    both = manifest.select("file", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want")).join(files.select("file", "bytes", "sha256"), "file", "full_outer")
    outcome = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("bytes") != F.col("want_bytes"), "size").when(F.col("sha256") != F.col("want"), "digest").otherwise("verified")
    return both.select("file", outcome.alias("outcome"))


def config_differences(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, key, saved, wanted of wanted settings (id, config map) that differ or that the saved configuration lacks."""
    pairs = lambda df, c: df.select("id", F.explode("config").alias("key", c))
    both = pairs(wanted, "wanted").join(pairs(saved, "saved"), ["id", "key"], "left")
    return both.where(~F.col("saved").eqNullSafe(F.col("wanted"))).select("id", "key", "saved", "wanted")


def adapter_compatible(config: Column) -> Column:
    """Whether an adapter's configuration (JSON text) is an ordinary one: causal language model, LoRA, nothing trained beside it."""
    v = F.try_parse_json(config)
    text = lambda key: F.coalesce(F.to_json(F.try_variant_get(v, f"$.{key}", "variant")), F.lit("null"))
    absent = lambda key: text(key).isin("null", "false", "0", "0.0", '""', "[]", "{}")
    given = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    plain = (text("peft_type") == '"LORA"') & (text("task_type") == '"CAUSAL_LM"') & F.when(given("bias"), text("bias") == '"none"').otherwise(F.lit(True))
    for key in ("lora_bias", "modules_to_save", "layer_replication", "use_dora", "trainable_token_indices", "alora_invocation_tokens"):
        plain = plain & absent(key)
    start = F.when(given("init_lora_weights"), text("init_lora_weights").isin("true", "false", '"gaussian"', "1", "0")).otherwise(F.lit(True))
    return F.coalesce(plain & start, F.lit(False))


def completion_error(config: Column, state: Column, metrics: Column) -> Column:
    """The first way in which a run is not a completed one, or null: JSON texts of its configuration, trainer state and metrics.

    The schedule is that of one device and no dropped batches: updates an epoch are ceil(batches / accumulation), steps are
    ``max_steps`` if that is over 0, else ceil(epochs * updates); the last epoch counts the batches that its updates took,
    and epochs agree within 10^-6. A run of three steps is a trial without validation.
    """
    c, s, m = (F.try_parse_json(x) for x in (config, state, metrics))
    part = lambda v, key: F.try_variant_get(v, f"$.{key}", "variant")
    kind = lambda v, key: F.coalesce(F.schema_of_variant(part(v, key)), F.lit("VOID"))

    def whole(v: Column, key: str, least: int) -> tuple[Column, Column]:
        value = F.try_variant_get(v, f"$.{key}", "bigint")
        return value, ~F.coalesce((kind(v, key) == "BIGINT") & (value >= least), F.lit(False))

    def number(v: Column, key: str) -> tuple[Column, Column]:
        value = F.try_variant_get(v, f"$.{key}", "double")
        is_number = kind(v, key).isin("BIGINT", "DOUBLE", "FLOAT") | kind(v, key).startswith("DECIMAL")
        return value, ~F.coalesce(is_number & (value >= 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))

    (examples, e1), (micro, e2), (accumulation, e3), (epochs, e4), (limit, e5) = whole(c, "examples", 1), whole(c, "micro_batch", 1), whole(c, "accumulation", 1), number(c, "epochs"), whole(c, "max_steps", -1)
    batches = F.ceil(examples / micro)
    updates = F.ceil(batches / accumulation)
    steps = F.when(limit > 0, limit).otherwise(F.ceil(epochs * updates))
    reached = F.floor(steps / updates) + F.least(steps % updates * accumulation, batches) / batches
    (step, e6), (planned, e7), (epoch, e8), (seen, e9) = whole(s, "global_step", 0), whole(s, "max_steps", 1), number(s, "epoch"), number(m, "epoch")
    (_, e10), (_, e11), (_, e12) = number(m, "train_runtime"), number(m, "train_loss"), number(m, "eval_loss")
    size = part(s, "train_batch_size")
    other = size.isNotNull() & (kind(s, "train_batch_size") != "VOID") & ~F.coalesce(F.try_variant_get(s, "$.train_batch_size", "double") == micro, F.lit(False))
    rules = [
        (c.isNull() | s.isNull() | m.isNull(), "json"), (e1, "examples"), (e2, "micro_batch"), (e3, "accumulation"), (e4 | ~(epochs > 0), "epochs"), (e5 | (limit == 0), "max_steps"),
        (~(steps > 0), "no steps"), (e6 | (step != steps), "global_step"), (e7 | (planned != steps), "planned steps"), (other, "train_batch_size"), (e8, "epoch"), (e9, "metrics epoch"),
        (F.abs(epoch - reached) > 1e-6, "epoch"), (F.abs(seen - epoch) > 1e-6, "metrics epoch"), (e10, "train_runtime"), (e11, "train_loss"), ((limit != 3) & e12, "eval_loss"),
    ]
    return F.coalesce(*[F.when(bad, name) for bad, name in rules])


def private_fields(documents: DataFrame) -> DataFrame:
    """id, path, reason of private keys ('key'), and private texts in keys ('name') and values ('value') of ``documents`` (id, json), however deep.

    A sensitive key with null or an empty text is allowed. Malformed JSON, that with a repeated key too, has one reason, 'json'; null has
    none. What is nested deeper than one walk reaches is walked on from there, until nothing is left.
    """
    brackets = F.length("json") - F.length(F.translate("json", "{[", ""))
    parsed = documents.select("id", F.col("json").isNotNull().alias("given"), F.try_parse_json("json").alias("value"), (brackets > V.DEPTH).alias("deep"))
    found = parsed.where("given and value is null").select("id", F.lit("$").alias("path"), F.lit("json").alias("reason"))
    empty = F.coalesce(F.is_variant_null("value") | (F.to_json("value") == '""'), F.lit(True))
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    hits = F.array_compact(F.array(
        F.when(F.lower("key").isin(*SENSITIVE_KEYS) & ~empty, "key"), F.when(F.col("key").rlike(PRIVATE_TEXT), "name"), F.when(text.rlike(PRIVATE_TEXT), "value")))
    left, seen = parsed.where("value is not null").select("id", F.lit("$").alias("above"), "value", "deep"), F.lit(True)
    while True:
        whole = F.concat("above", F.substring("path", 2, 1 << 30))
        each = left.select("id", "above", "deep", F.inline(V.nodes(F.col("value"), dotted=True)))
        found = found.unionByName(each.where(seen).select("id", whole.alias("path"), F.explode(hits).alias("reason")))
        # Kept, so that a round doesn't walk all those before it again; only values nested so deep are in it.
        left, seen = each.where("deep and open").select("id", whole.alias("above"), "value", "deep").persist(), F.col("path") != "$"
        if left.isEmpty():
            return found
