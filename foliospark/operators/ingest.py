"""From fetched pages to documents, merge actions and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import chunks as C
from foliospark.functions import text as T
from foliospark.functions import urls as U
from foliospark.functions.lexicon import BREAKING, DEPRECATION

MIN_PAGE_CHARS = 120


def without_noise(text: Column, source: Column, policies: dict[str, U.CrawlPolicy]) -> Column:
    """A page's text without the noise lines that its source's policy names; other sources keep theirs."""

    def cut(whole: Column) -> Column:
        out = whole
        for name, p in policies.items():
            out = F.when(source == name, T.strip_noise_lines(whole, p.noise_lines)).otherwise(out)
        return out

    return T.let(text, cut)


def page_documents(pages: DataFrame, policies: dict[str, U.CrawlPolicy] | None = None) -> DataFrame:
    """Pages (source_id, url, status, html, ...) to documents; short or failed pages have accepted = false.

    ``policies`` by source id name the noise lines to leave out.
    """
    main = T.main_html(F.col("html"))
    text = T.html_to_text(T.strip_html_noise(main))
    if policies:
        text = without_noise(text, F.col("source_id"), policies)
    staged = pages.select(
        "*",
        U.canonical_url(F.col("url")).alias("canonical_url"),
        T.page_title(F.col("html"), F.col("url")).alias("title"),
        T.sanitize_lines(text).alias("clean"),
        U.page_links(main, F.col("url")).alias("links"),
    )
    ok = F.col("status").between(200, 299) & (F.length("clean.text") >= MIN_PAGE_CHARS)
    return staged.select(
        *pages.columns, "canonical_url", "title", F.col("clean.text").alias("content"),
        F.col("clean.removed_lines").alias("removed_lines"), F.col("clean.findings").alias("findings"),
        C.chunks(F.col("clean.text")).alias("chunks"), "links", F.coalesce(ok, F.lit(False)).alias("accepted"),
    )


def run_status(pages: DataFrame) -> DataFrame:
    """Status of each source's run: failed, partial or success."""
    bad = ~F.col("status").between(200, 299) & (F.col("status") != 304)
    counted = pages.groupBy("source_id").agg(
        F.count_if("accepted").alias("documents"), F.count_if(bad).alias("errors"), F.sum("removed_lines").alias("removed")
    )
    status = (
        F.when((F.col("documents") == 0) & (F.col("errors") > 0), "failed")
        .when((F.col("documents") == 0) | (F.col("errors") > 0) | (F.col("removed") > 0), "partial")
        .otherwise("success")
    )
    return counted.withColumn("run_status", status)


def _key(df: DataFrame) -> list[Column]:
    return [df["source_id"], df["canonical_url"], F.coalesce(df["version_tag"], F.lit(""))]


def merge_actions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One join on the business key: insert, update, backfill or touch for each incoming document.

    ``current`` has content_hash and chunks_plain (no chunk has a heading or a language).
    """
    on = [x.eqNullSafe(y) for x, y in zip(_key(incoming), _key(current), strict=True)]
    joined = incoming.join(current.withColumn("__known", F.lit(True)), on, "left")
    action = (
        F.when(F.col("__known").isNull(), "insert")
        .when(incoming["content_hash"] != current["content_hash"], "update")
        .when(current["chunks_plain"], "backfill")
        .otherwise("touch")
    )
    return joined.select(*[incoming[c] for c in incoming.columns], current["content_hash"].alias("previous_hash"), action.alias("action"))


def plain_documents(chunks: DataFrame) -> DataFrame:
    """(document_id, chunks_plain): whether none of a document's chunks has a heading or a language; blank ones count as none."""
    blank = lambda c: F.coalesce(T.trim_ws(F.col(c)), F.lit("")) == ""
    bare = blank("heading_path") & blank("code_lang")
    return chunks.groupBy("document_id").agg((F.count(F.lit(1)) == F.count_if(bare)).alias("chunks_plain"))


def merged_documents(current: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """Next version of the document table: new rows, updated rows and untouched ones, by a full outer join.

    Content, hash and last change move only if the hash differs; fetch headers keep their old value where none came.
    """
    cols = [c for c in current.columns if c not in ("source_id", "canonical_url", "version_tag")]
    keyed = lambda df: df.withColumn("version_tag", F.coalesce("version_tag", F.lit("")))
    old = keyed(current).select("source_id", "canonical_url", "version_tag", F.struct(*cols).alias("o"))
    new = keyed(incoming).select(
        "source_id", "canonical_url", "version_tag",
        F.struct(*[c for c in incoming.columns if c not in ("source_id", "canonical_url", "version_tag")]).alias("n"),
    )
    both = old.join(new, ["source_id", "canonical_url", "version_tag"], "full")
    fresh, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    changed = fresh & (~known | (F.col("o.content_hash") != F.col("n.content_hash")))
    have = set(incoming.columns)

    def value(c: str) -> Column:
        if c in ("content_hash", "content", "chunks_plain") and c in have:
            return F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c == "last_changed_at":
            return F.when(changed, at).otherwise(F.col("o.last_changed_at"))
        if c == "first_seen_at":
            return F.coalesce(F.col("o.first_seen_at"), at)
        if c == "last_seen_at":
            return F.when(fresh, at).otherwise(F.col("o.last_seen_at"))
        if c in have:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.col(f"o.{c}")

    tag = F.nullif("version_tag", F.lit("")).alias("version_tag")
    return both.select("source_id", "canonical_url", tag, *[value(c).alias(c) for c in cols])


def replace_chunks(chunks: DataFrame, documents: DataFrame, at: Column) -> DataFrame:
    """Drops all chunks of the given documents (document_id, chunks) and puts in theirs, numbered from 0."""
    kept = chunks.join(documents.select("document_id"), "document_id", "left_anti")
    # exploded, so that chunks are cut once: else a filter for those without any cuts them too
    whole = documents.select("document_id", F.explode(F.array("chunks")).alias("chunks"))
    new = whole.select("document_id", F.posexplode("chunks").alias("chunk_index", "c")).select(
        F.concat(F.lit("chk_"), F.sha2(F.concat_ws("#", "document_id", "chunk_index"), 256)).alias("id"),
        "document_id", "chunk_index", F.col("c.text").alias("text"), T.token_count(F.col("c.text")).alias("token_count"),
        F.col("c.heading_path").alias("heading_path"), F.col("c.code_lang").alias("code_lang"),
        at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return kept.select(*new.columns).union(new)


def touch_not_modified(documents: DataFrame, not_modified: DataFrame, at: Column) -> DataFrame:
    """Marks documents (all versions of source and URL) whose fetch said they didn't change."""
    given = lambda c: F.col(c) if c in not_modified.columns else F.lit(None)
    seen = not_modified.select(
        "source_id", "canonical_url", F.coalesce(given("status"), F.lit(304)).alias("__status"),
        given("etag").cast("string").alias("__etag"), given("last_modified").cast("string").alias("__modified"),
        F.coalesce(given("checked_at").cast("timestamp_ntz"), at).alias("__checked"),
    )
    both = documents.join(seen, ["source_id", "canonical_url"], "left")
    hit = F.col("__status").isNotNull()
    new = {
        "last_seen_at": at, "fetch_last_checked_at": F.col("__checked"), "fetch_last_status": F.col("__status"),
        "fetch_etag": F.coalesce("__etag", F.col("fetch_etag")) if "fetch_etag" in documents.columns else None,
        "fetch_last_modified": F.coalesce("__modified", F.col("fetch_last_modified")) if "fetch_last_modified" in documents.columns else None,
    }
    return both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if new.get(c) is not None else c for c in documents.columns])


def run_events(merged: DataFrame, keep: list[str]) -> DataFrame:
    """Events of a run: document_added for inserts, change events for updates.

    ``merged`` has action, title, previous (text) and next (text).
    """
    added = merged.where("action = 'insert'").select(
        *keep, F.lit("document_added").alias("event_type"), F.lit("low").alias("severity"), F.lit("new_document").alias("detector"),
        F.lit(None).cast("string").alias("keyword_family"), F.concat(F.lit("Added: "), "title").alias("summary"),
        F.array().cast("array<string>").alias("changed_sections"), F.lit(0).cast("long").alias("changed_section_count"),
    )
    return added.union(change_events(merged.where("action = 'update'"), keep))


def run_counters(merged: DataFrame, events: DataFrame) -> DataFrame:
    """Documents inserted and updated, chunks written and events made by source; ``merged`` has action and n_chunks."""
    done = merged.groupBy("source_id").agg(
        F.count_if(F.col("action") == "insert").alias("inserted_documents"),
        F.count_if(F.col("action") == "update").alias("updated_documents"),
        F.sum(F.when(F.col("action") != "touch", F.col("n_chunks")).otherwise(0)).cast("long").alias("inserted_chunks"),
    )
    made = events.groupBy("source_id").agg(F.count(F.lit(1)).alias("change_events"))
    return done.join(made, "source_id", "left").withColumn("change_events", F.coalesce("change_events", F.lit(0)))


def run_line(counters: DataFrame) -> DataFrame:
    """A line for the log of each source's run; ``counters`` has run_status too."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    line = F.concat_ws(
        " ", part("source", "source_id"), part("docs_inserted", "inserted_documents"), part("docs_updated", "updated_documents"),
        part("chunks_inserted", "inserted_chunks"), part("change_events", "change_events"), part("status", "run_status"),
    )
    return counters.select("source_id", line.alias("line"))


def _first(rows: DataFrame, order: list, value: str, most: int, by: str, name: str) -> DataFrame:
    """The first ``most`` values of each source, joined; ranks are cut before rows meet."""
    ranked = rows.withColumn("__n", F.row_number().over(W.partitionBy("source_id").orderBy(*order))).where(F.col("__n") <= most)
    grouped = ranked.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("__n", F.col(value).alias("v")))).alias("__v"))
    return grouped.select("source_id", F.array_join(F.transform("__v", lambda x: x["v"]), by).alias(name))


def run_snapshots(pages: DataFrame, request: Column) -> DataFrame:
    """A snapshot row for each source's run: first eight URLs fetched, first ten errors, status.

    ``pages`` has source_id, url, status, accepted, removed_lines, error and place (order of fetches).
    """
    urls = _first(pages.where("error is null"), ["place", "url"], "url", 8, ",", "raw_blob_ref")
    errors = _first(pages.where("error is not null"), ["place", "url"], "error", 10, " | ", "error")
    both = run_status(pages).join(urls, "source_id", "left").join(errors, "source_id", "left")
    ref = F.coalesce("raw_blob_ref", F.concat(F.lit("queue://source-sync/"), request))
    return both.select("source_id", ref.alias("raw_blob_ref"), F.col("run_status").alias("status"), "error")


def document_text(chunks: DataFrame) -> DataFrame:
    """A document's text as its chunks give it, joined by blank lines."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    grouped = chunks.groupBy("document_id").agg(parts.alias("p"))
    return grouped.select("document_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def changed_sections(previous: Column, next_: Column) -> Column:
    """Sections of the next text that are new or differ after normalising; of equal earlier headings the last counts.

    Only sections whose text differs as it stands are normalised.  For stored documents see ``changes``, which
    compares digests.
    """

    def changed(before: Column) -> Column:
        def is_changed(s: Column) -> Column:
            old = F.coalesce(F.try_element_at(F.filter(before, lambda p: p["heading"] == s["heading"]), F.lit(-1))["body"], F.lit(""))
            return T.let(old, lambda x: (x != s["body"]) & (T.diff_form(x) != T.diff_form(s["body"])))

        return F.filter(C.diff_sections(next_), is_changed)

    return T.let(C.diff_sections(previous), changed)


#: The longest word of each wording: a text with the wording holds it, whatever white space lies around it.
_MARKS = tuple(dict.fromkeys(max(w.split(" "), key=len) for w in (*BREAKING, *DEPRECATION)))


def _neither() -> Column:
    return F.struct(F.lit(False).alias("breaking"), F.lit(False).alias("deprecated"))


def wording(text: Column) -> Column:
    """(breaking, deprecated): whether a text has wording of breaking changes and of deprecations, after normalising.

    A text without the longest word of any of them isn't normalised.
    """
    flags = lambda form: F.struct(has_word(form, BREAKING).alias("breaking"), has_word(form, DEPRECATION).alias("deprecated"))
    return T.let(F.lower(text), lambda low: F.when(has_word(low, _MARKS), T.let(T.diff_form(text), flags)).otherwise(_neither()))


def introduced(previous: Column, changed: Column) -> Column:
    """Whether changed sections bring in wording of breaking changes and of deprecations that the previous text lacked.

    The previous text is looked at only if they have such wording.
    """

    def new(now: Column) -> Column:
        lacked = lambda before: F.struct(*((now[k] & ~before[k]).alias(k) for k in ("breaking", "deprecated")))
        return F.when(now["breaking"] | now["deprecated"], T.let(wording(previous), lacked)).otherwise(_neither())

    return T.let(wording(F.array_join(F.transform(changed, lambda s: s["body"]), "\n")), new)


def change_events(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Events of changed documents; ``pairs`` has previous, next and title. Equal texts give none."""
    moved = pairs.where(~F.col("previous").eqNullSafe(F.col("next")))

    def judge(changed: Column) -> Column:
        return F.struct(introduced(F.col("previous"), changed).alias("flags"), changed.alias("changed"))

    seen = T.let(changed_sections(F.col("previous"), F.col("next")), judge)
    judged = moved.select(*keep, "title", F.explode(F.array(seen)).alias("j"))  # exploded, so that it is computed once
    return events_of(judged.select(*keep, "title", "j.flags", F.transform("j.changed", lambda s: s["heading"]).alias("headings")), keep)


def events_of(judged: DataFrame, keep: list[str]) -> DataFrame:
    """Events by the flags (breaking, deprecated) and headings of each changed document."""
    none = F.lit(None).cast("string")

    def event(kind: str, severity: str, detector: str, family: Column, lead: str) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"), F.lit(detector).alias("detector"),
            family.alias("keyword_family"), F.concat(F.lit(lead), "title").alias("summary"),
        )

    breaking, deprecated = F.col("flags.breaking"), F.col("flags.deprecated")
    found = F.array(
        F.when(breaking, event("breaking_change", "critical", "section_diff_keyword", F.lit("breaking_or_removed"), "Possible breaking change in ")),
        F.when(deprecated, event("deprecation", "medium", "section_diff_keyword", F.lit("deprecation"), "New deprecation wording in ")),
        F.when(~breaking & ~deprecated, event("updated", "low", "section_diff", none, "Updated: ")),
    )
    return judged.select(
        *keep, F.explode(F.array_compact(found)).alias("e"),
        F.slice("headings", 1, 10).alias("changed_sections"), F.size("headings").cast("long").alias("changed_section_count"),
    ).select(*keep, "e.*", "changed_sections", "changed_section_count")


def primary_event(previous: Column, next_: Column) -> Column:
    """Type of the first event of a change."""
    kind = lambda f: F.when(f["breaking"], "breaking_change").when(f["deprecated"], "deprecation").otherwise("updated")
    return T.let(T.let(changed_sections(previous, next_), lambda changed: introduced(previous, changed)), kind)
