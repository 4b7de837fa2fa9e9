"""Versioned documents: parsing and rendering markdown, deltas, reconstruction, search, status."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 1 << 20
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def parse_markdown(text: str) -> dict:
    """{meta, sections}: `key: value` front matter between `---` lines (lists in brackets), then headings with their bodies."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("document is over 1 MB")
    meta: dict[str, object] = {}
    lines = text.split("\n")
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
        for line in lines[1:end]:
            key, colon, value = line.partition(":")
            if colon:
                value = value.strip()
                meta[key.strip()] = [v.strip() for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else value
        lines = lines[end + 1 :]
    sections: list[dict] = []
    for line in lines:
        m = HEADING.match(line)
        if m:
            sections.append({"level": len(m[1]), "heading": m[2], "body": []})
        elif sections:
            sections[-1]["body"].append(line)
        elif line.strip():
            sections.append({"level": 0, "heading": "", "body": [line]})
    return {"meta": meta, "sections": [s | {"body": "\n".join(s["body"]).strip("\n")} for s in sections]}


def render_markdown(doc: dict) -> str:
    """Inverse of parse_markdown for what it gives."""
    out = []
    if doc["meta"]:
        show = lambda v: "[" + ", ".join(v) + "]" if isinstance(v, list) else v
        out += ["---", *(f"{k}: {show(v)}" for k, v in doc["meta"].items()), "---", ""]
    for s in doc["sections"]:
        if s["level"]:
            out.append(f"{'#' * s['level']} {s['heading']}")
        out += [s["body"], ""] if s["body"] else [""]
    return "\n".join(out)


def delta(old: str, new: str) -> str:
    """Edit script from old to new: equal stretches by length, new ones by text; exact for any text."""
    import json

    a, b = old.splitlines(True), new.splitlines(True)
    ops = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        ops.append([i, j] if op == "equal" else "".join(b[k:m]))
    return json.dumps(ops)


def patch(old: str, script: str) -> str:
    import json

    a = old.splitlines(True)
    return "".join(x if isinstance(x, str) else "".join(a[x[0] : x[1]]) for x in json.loads(script))


def unified(old: str, new: str, a: str = "old", b: str = "new") -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), a, b))


def upload(texts: DataFrame) -> DataFrame:
    """skill_id, version, full, delta, digest from (skill_id, version, text): version 0 whole, later ones as deltas."""

    def fold(pdf):
        import hashlib

        pdf = pdf.sort_values("version")
        before, full, scripts = None, [], []
        for text in pdf["text"]:
            full.append(text if before is None else None)
            scripts.append(None if before is None else delta(before, text))
            before = text
        return pdf[["skill_id", "version"]].assign(full=full, delta=scripts, digest=[hashlib.sha256(t.encode()).hexdigest() for t in pdf["text"]])

    return texts.select("skill_id", "version", "text").groupBy("skill_id").applyInPandas(fold, "skill_id string, version bigint, full string, delta string, digest string")


def reconstruct(versions: DataFrame) -> DataFrame:
    """skill_id, version, text, intact: every version replayed from the first; intact compares its digest."""

    def fold(pdf):
        import hashlib

        pdf = pdf.sort_values("version")
        text, out = "", []
        for full, script in zip(pdf["full"], pdf["delta"], strict=True):
            text = full if full is not None else patch(text, script)
            out.append(text)
        same = [hashlib.sha256(t.encode()).hexdigest() == d for t, d in zip(out, pdf["digest"], strict=True)]
        return pdf[["skill_id", "version"]].assign(text=out, intact=same)

    return versions.groupBy("skill_id").applyInPandas(fold, "skill_id string, version bigint, text string, intact boolean")


def summaries(versions: DataFrame) -> DataFrame:
    """skill_id, versions, latest: newest version of each."""
    return versions.groupBy("skill_id").agg(F.count("*").alias("versions"), F.max("version").alias("latest"), F.max_by("digest", "version").alias("digest"))


DOCUMENT = "struct<meta:map<string,string>,sections:array<struct<level:int,heading:string,body:string>>,warnings:array<string>>"


def parsed(texts: DataFrame, column: str = "text", form: str = "markdown") -> DataFrame:
    """texts with `doc`: meta, sections and warnings of every document, in Markdown or as JSON of that shape.

    A document that cannot be read (too long, no JSON) has neither, and a warning that says why. Lists in meta are joined by ", ".
    """
    if form == "json":
        small = F.length(F.col(column).cast("binary")) <= MOST_BYTES
        doc = F.from_json(F.when(small, F.col(column)), DOCUMENT)
        wrong = F.when(~small, "document is over 1 MB").when(doc["sections"].isNull(), "no JSON document")
        none = F.array().cast("array<struct<level:int,heading:string,body:string>>")
        made = F.struct(F.coalesce(doc["meta"], F.create_map().cast("map<string,string>")).alias("meta"), F.coalesce(doc["sections"], none).alias("sections"), F.array_compact(F.array(wrong)).alias("warnings"))
        return texts.withColumn("doc", made)

    @F.pandas_udf("meta map<string,string>, sections array<struct<level:int,heading:string,body:string>>, warnings array<string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = []
            for text in some:
                try:
                    doc = parse_markdown(text or "")
                    rows.append(({k: ", ".join(v) if isinstance(v, list) else v for k, v in doc["meta"].items()}, [(s["level"], s["heading"], s["body"]) for s in doc["sections"]], []))
                except ValueError as e:
                    rows.append(({}, [], [str(e)]))
            yield pd.DataFrame(rows, columns=["meta", "sections", "warnings"])

    return texts.withColumn("doc", parse(column))


def rendered(docs: DataFrame, column: str = "doc", form: str = "markdown") -> DataFrame:
    """docs with `text`: the document of `doc` (meta, sections) written out again."""
    if form == "json":
        return docs.withColumn("text", F.to_json(F.struct(F.col(column)["meta"].alias("meta"), F.col(column)["sections"].alias("sections"))))
    d = F.col(column)
    meta = F.transform(F.map_entries(d["meta"]), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    head = F.when(F.size(meta) > 0, F.concat(F.lit("---\n"), F.array_join(meta, "\n"), F.lit("\n---\n")))
    part = lambda s: F.concat_ws("\n", F.when(s["level"] > 0, F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["heading"])), F.when(s["body"] != "", s["body"]), F.lit(""))
    return docs.withColumn("text", F.concat_ws("\n", head, F.array_join(F.transform(d["sections"], part), "\n")))


def diffs(versions: DataFrame, old: int, new: int) -> DataFrame:
    """skill_id, diff: the unified diff of two versions (skill_id, version, text) of each document that has both."""

    @F.pandas_udf("string")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unified(x, y, f"v{old}", f"v{new}") for x, y in zip(a, b, strict=True)])

    one = versions.where(F.col("version") == old).select("skill_id", F.col("text").alias("old_text"))
    two = versions.where(F.col("version") == new).select("skill_id", F.col("text").alias("new_text"))
    return one.join(two, "skill_id").select("skill_id", compare("old_text", "new_text").alias("diff"))


def status_of(events: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """skill_id, status, reason after all events (skill_id, seq, status, reason) and uploads (skill_id, seq).

    The last event counts; an upload after it makes a deprecated document active again, a revoked one stays revoked.
    """
    last = events.groupBy("skill_id").agg(F.max_by(F.struct("status", "reason"), "seq").alias("e"), F.max("seq").alias("at"))
    out = last.select("skill_id", F.col("e.status").alias("status"), F.col("e.reason").alias("reason"), "at")
    if uploads is None:
        return out.drop("at")
    again = uploads.groupBy("skill_id").agg(F.max("seq").alias("uploaded"))
    out = again.join(out, "skill_id", "full_outer")
    back = F.col("status").isNull() | ((F.col("status") != "Revoked") & (F.coalesce(F.col("uploaded") > F.col("at"), F.lit(False))))
    return out.select("skill_id", F.when(back, "Active").otherwise(F.col("status")).alias("status"), F.when(~back, F.col("reason")).alias("reason"))


def with_status(skills: DataFrame, events: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """skills with status and reason as status_of has them, in place of columns of these names; Active without any."""
    found = status_of(events, uploads).withColumnsRenamed({"status": "new_status", "reason": "new_reason"})
    kept = [c for c in skills.columns if c not in ("status", "reason")]
    return skills.select(*kept).join(found, "skill_id", "left").select(*kept, F.coalesce("new_status", F.lit("Active")).alias("status"), F.col("new_reason").alias("reason"))


def read(versions: DataFrame, statuses: DataFrame, version: int | None = None, form: str = "markdown") -> DataFrame:
    """skill_id, version, text, meta, sections, warnings, status, reason, intact: one version of every document, the newest if none is named.

    versions: as upload() stores them; statuses: as of status_of(). A document that is not active is read with a warning.
    """
    texts = reconstruct(versions)
    if version is None:
        texts = texts.join(versions.groupBy("skill_id").agg(F.max("version").alias("version")), ["skill_id", "version"], "left_semi")
    else:
        texts = texts.where(F.col("version") == version)
    rows = parsed(texts, form=form).join(statuses, "skill_id", "left").withColumn("status", F.coalesce("status", F.lit("Active")))
    about = F.when(F.col("status") != "Active", F.concat(F.lower("status"), F.lit(": "), F.coalesce("reason", F.lit("no reason given"))))
    return rows.select("skill_id", "version", "text", "doc.meta", "doc.sections", F.concat(F.col("doc.warnings"), F.array_compact(F.array(about))).alias("warnings"), "status", "reason", "intact")


def manifest(versions: DataFrame) -> DataFrame:
    """skill_id, versions, digest, problem: the digest over all versions' digests, and what is wrong with the row of versions."""
    rows = F.sort_array(F.collect_list(F.struct("version", "digest", F.col("full").isNotNull().alias("whole"))))
    made = versions.groupBy("skill_id").agg(rows.alias("v"))  # a row for each version of one document
    gap = F.exists(F.transform("v", lambda x, i: x["version"] != i), lambda x: x)
    first = ~F.element_at("v", 1)["whole"]
    problem = F.when(gap, "versions are missing or repeated").when(first, "the first version is not whole")
    return made.select("skill_id", F.size("v").alias("versions"), F.sha2(F.array_join(F.transform("v", lambda x: x["digest"]), "\n"), 256).alias("digest"), problem.alias("problem"))


def migrate(old: DataFrame) -> DataFrame:
    """Versions stored whole (skill_id, version, text), as of the first format, as upload() stores them now."""
    return upload(old)


def accept_uploads(uploads: DataFrame, agents: DataFrame, verify: Callable[[bytes, bytes, bytes], bool]) -> DataFrame:
    """uploads (agent_id, text, key_id, signature) with `accepted` and `refusal`.

    An agent with live keys (agents: agent_id, public_keys) must sign the text with one of them; others need not.
    verify(public key, message, signature) is the caller's Ed25519.
    """
    live = F.filter("public_keys", lambda k: k["revoked_at"].isNull())
    rows = uploads.join(agents.select("agent_id", live.alias("live")), "agent_id", "left")

    @F.pandas_udf("boolean")
    def signed(keys: pd.Series, texts: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([k is not None and s is not None and bool(verify(bytes(k), (t or "").encode(), bytes(s))) for k, t, s in zip(keys, texts, signatures, strict=True)])

    rows = rows.withColumn("needs", F.coalesce(F.size("live") > 0, F.lit(False))).withColumn("public_key", F.get(F.transform(F.filter("live", lambda k: k["key_id"] == F.col("key_id")), lambda k: k["public_key_bytes"]), F.lit(0)))
    rows = rows.withColumn("good", signed("public_key", "text", "signature"))
    refusal = F.when(F.col("needs") & F.col("signature").isNull(), "unsigned").when(F.col("needs") & F.col("public_key").isNull(), "unknown key").when(F.col("needs") & ~F.col("good"), "wrong signature")
    return rows.withColumn("refusal", refusal).withColumn("accepted", F.col("refusal").isNull()).select(*uploads.columns, "accepted", "refusal")


def search(skills: DataFrame, ids=(), names=(), tags=(), triggers=(), statuses=(), text: str | None = None, limit: int | None = None, uploader_ids=(), uploader_names=(), uploader_owners=(), formats=(), schemas=(), since=None, until=None) -> DataFrame:
    """Skills that fit all given filters, values of one ORed, whatever the case; newest first if there is a limit.

    text is part of name, description, a warning, or the heading or body of a section. since and until bound updated_at, both inclusive.
    """
    lower = lambda xs: [x.lower() for x in xs]
    for column, values in (("skill_id", ids), ("name", names), ("status", statuses), ("uploader_id", uploader_ids), ("uploader_name", uploader_names), ("uploader_owner", uploader_owners), ("format", formats)):
        if values:
            skills = skills.where(F.lower(column).isin(lower(values)))
    if schemas:
        skills = skills.where(F.col("schema_version").isin(list(schemas)))
    if since is not None:
        skills = skills.where(F.col("updated_at") >= F.lit(since))
    if until is not None:
        skills = skills.where(F.col("updated_at") <= F.lit(until))
    for column, values in (("tags", tags), ("triggers", triggers)):
        if values:
            wanted = lower(values)
            skills = skills.where(F.exists(column, lambda v: F.lower(v).isin(wanted)))  # noqa: B023
    if text is not None:
        n = F.lit(text.lower())
        inside = lambda c: F.coalesce(F.contains(F.lower(c), n), F.lit(False))
        found = inside("name") | inside("description") | F.coalesce(F.exists("sections", lambda s: F.contains(F.lower(s["heading"]), n) | F.contains(F.lower(s["body"]), n)), F.lit(False))
        if "warnings" in skills.columns:
            found = found | F.coalesce(F.exists("warnings", lambda v: F.contains(F.lower(v), n)), F.lit(False))
        skills = skills.where(found)
    return skills if limit is None else skills.orderBy(F.desc("updated_at"), "skill_id").limit(limit)
