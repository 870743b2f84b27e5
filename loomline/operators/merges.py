"""Tables merged into tables: conditional patches of edit lists, stale lists put aside, recordings and transcripts matched and updated.

A batch is matched with the tables as they were before it; inside a batch, what comes last (by seq) wins, column by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import edits
from .groups import kept


def list_digests(entries: DataFrame) -> DataFrame:
    """doc, size, digest: SHA-256 over the entries of each list in order."""
    one = F.struct("pos", F.to_json(F.struct(*edits.FIELDS), {"ignoreNullFields": "false"}).alias("json"))
    whole = entries.groupBy("doc").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(one)).alias("a"))
    return whole.select("doc", "size", F.sha2(F.array_join(F.transform("a", lambda e: e["json"]), "\n"), 256).alias("digest"))


def patched(entries: DataFrame, patches: DataFrame, sources: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists after patches (doc, seq, against, start, gone, put), and (doc, seq, outcome).

    A patch puts `put` in the place of `gone` entries at `start`, if the list still has the digest `against`; so of two made against one
    list the first applies and the other finds it changed. Outcomes: applied, changed, outside (of the list), no such list, or
    what would be wrong with the list (violations), in which case it stays as it was.
    """
    now = list_digests(entries).select("doc", "size", "digest")
    p = patches.join(now, "doc", "left")
    fits = (F.col("start") >= 0) & (F.col("start") <= F.col("size")) & (F.col("gone") >= 0) & (F.col("gone") <= F.col("size") - F.col("start"))
    ready = F.col("digest").isNotNull() & F.equal_null("against", "digest") & F.coalesce(fits, F.lit(False))
    own = Window.partitionBy("doc")
    p = kept(p.withColumn("first", F.min(F.when(ready, F.col("seq"))).over(own)), "doc")
    chosen = p.where("seq = first")
    put = chosen.select("doc", F.posexplode("put").alias("at", "e")).select("doc", "at", "e.*")
    tried = edits.splice(entries.join(chosen.select("doc"), "doc", "left_semi"), chosen.select("doc", "start", (F.col("start") + F.col("gone")).alias("stop")), put)
    wrong = kept(edits.violations(tried, sources, names).select("doc", F.concat(F.lit("broken: "), "reason").alias("wrong")), "doc")
    good = chosen.select("doc").join(wrong, "doc", "left_anti")
    after = entries.join(good, "doc", "left_anti").select("doc", "pos", *edits.FIELDS).unionByName(tried.join(good, "doc", "left_semi"))
    outcome = (
        F.when(F.col("digest").isNull(), "no such list")
        .when(F.col("seq") == F.col("first"), F.coalesce("wrong", F.lit("applied")))
        .when(~F.equal_null("against", "digest") | ((F.col("seq") > F.col("first")) & F.col("wrong").isNull()), "changed")
        .when(~F.coalesce(fits, F.lit(False)), "outside")
        .otherwise("not tried")
    )
    return after, p.join(wrong, "doc", "left").select("doc", "seq", outcome.alias("outcome"))


def settled(lists: DataFrame, transcripts: DataFrame, asides: DataFrame) -> DataFrame:
    """doc, state, aside, made_from, names of each list: kept, or put aside because its transcript was made again.

    lists: (doc, made_from, names), transcripts: (doc, sha), asides: (doc, digest) put aside before. A stale list goes to
    doc.digest12, or with the next free number behind it; the fresh list is made from the new transcript and keeps the names.
    """
    before = asides.select("doc", F.substring("digest", 1, 12).alias("d")).groupBy("doc", "d").agg(F.count(F.lit(1)).alias("n"))
    j = lists.join(transcripts, "doc").withColumn("d", F.substring("made_from", 1, 12)).join(before, ["doc", "d"], "left")
    stale = F.col("made_from").isNotNull() & (F.col("made_from") != F.col("sha"))
    name = F.concat_ws("", F.col("doc").cast("string"), F.lit("."), "d", F.when(F.col("n") > 0, F.concat(F.lit("-"), (F.col("n") + 1).cast("string"))))
    return j.select("doc", F.when(stale, "aside").otherwise("kept").alias("state"), F.when(stale, name).alias("aside"), F.when(stale, F.col("sha")).otherwise(F.col("made_from")).alias("made_from"), "names")


def recordings_for(seen: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content_id, id) of what was seen, and the recordings after it.

    seen: (path, content_id, seq), content_id null where no file is there; of a path the last row counts. recordings: (id, path,
    content_id, missing). Contents decide: the row of the same contents; else the newest row without contents at the path, which
    gets them; else a new row. Where no file is: the newest row at the path, which is then missing; else a new missing one.
    A known recording moves to the first path where it was seen, unless it was seen at its own; rows at a
    path that holds other contents now are missing. New ids follow the largest one, in the order of seq.
    """
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    s = seen.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")
    there, absent = s.where("content_id IS NOT NULL"), s.where("content_id IS NULL")
    known = recordings.where("content_id IS NOT NULL").select("content_id", F.col("id").alias("same"))
    empty = recordings.where("content_id IS NULL").groupBy("path").agg(F.max("id").alias("empty"))
    t = there.join(known, "content_id", "left").join(empty, "path", "left")
    t = t.withColumn("fills", F.when(F.col("same").isNull(), F.col("empty")))
    t = t.withColumn("fills", F.min(F.struct("seq", "fills")).over(Window.partitionBy("content_id"))["fills"])  # a content that is seen twice fills one row
    t = t.withColumn("id", F.coalesce("same", "fills"))
    newest = recordings.groupBy("path").agg(F.max("id").alias("id"))
    a = absent.join(newest, "path", "left")
    fresh = t.where("id IS NULL").groupBy("content_id").agg(F.min("seq").alias("seq"), F.min_by("path", "seq").alias("path"))
    fresh = fresh.select("path", "content_id", "seq", F.lit(False).alias("missing")).unionByName(a.where("id IS NULL").select("path", "content_id", "seq", F.lit(True).alias("missing")))
    fresh = numbered(fresh, "seq").crossJoin(recordings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))).select((F.col("top") + F.col("n")).alias("id"), "path", "content_id", "missing")
    made = fresh.select(F.col("id").alias("new"), F.col("content_id").alias("c"), F.col("path").alias("p"))
    matched = t.join(made.where("c IS NOT NULL"), F.col("content_id") == F.col("c"), "left").select("path", "content_id", F.coalesce("id", "new").alias("id"), "seq")
    gone = a.join(made.where("c IS NULL"), F.col("path") == F.col("p"), "left").select("path", F.lit(None).cast("string").alias("content_id"), F.coalesce("id", "new").alias("id"), "seq")
    here = matched.groupBy("id").agg(F.min_by("path", "seq").alias("to"), F.collect_set("path").alias("paths"), F.first("content_id").alias("filled"))
    held = there.select("path", F.col("content_id").alias("holds"))
    lost = gone.select("id", F.lit(True).alias("lost")).distinct()
    r = recordings.join(here, "id", "left").join(held, "path", "left").join(lost, "id", "left")
    stays = F.array_contains("paths", F.col("path"))
    other = F.col("content_id").isNotNull() & F.col("holds").isNotNull() & (F.col("holds") != F.col("content_id"))
    r = r.select(
        "id", F.when(F.col("to").isNotNull() & ~F.coalesce(stays, F.lit(False)), F.col("to")).otherwise(F.col("path")).alias("path"), F.coalesce("content_id", "filled").alias("content_id"),
        F.when(F.col("to").isNotNull(), F.lit(False)).when(other | F.col("lost"), F.lit(True)).otherwise(F.col("missing")).alias("missing"),
    )
    return matched.unionByName(gone).select("path", "content_id", "id"), r.unionByName(fresh.select("id", "path", "content_id", "missing"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with n from 1 in the order of a column, without one task that has all of them: counts of parts, then ranks inside."""
    ranged = rows.withColumn("__part", F.floor(F.col(order) / 65536))
    parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = parts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return ranged.join(before, "__part").withColumn("n", F.row_number().over(Window.partitionBy("__part").orderBy(order)) + F.col("__b")).drop("__part", "__b")


def upserted(transcripts: DataFrame, events: DataFrame) -> DataFrame:
    """transcripts (path, recording_id, engine, language, model, finished_at) after events, by path, column by column.

    events: (path, seq, kind, recording_id, engine, language, model, finished_at) of kind run (the run that wrote the file: all it says
    counts) or adopt (a file that was found: its model counts; its recording and time only for a new path; its engine only where none is
    known). A later event sees what earlier ones left.
    """
    run = F.col("kind") == "run"
    last_run = F.max(F.when(run, F.col("seq")))
    e = events.groupBy("path").agg(
        last_run.alias("run_seq"), F.count(F.lit(1)).alias("n_events"), F.max_by(F.struct("model"), "seq")["model"].alias("new_model"),
        *[F.max_by(F.struct(c), F.when(run, F.col("seq")))[c].alias(f"run_{c}") for c in ("recording_id", "engine", "language", "finished_at")],
        *[F.min_by(F.struct(c), "seq")[c].alias(f"first_{c}") for c in ("recording_id", "finished_at")],
        F.min_by("engine", F.when(~run & F.col("engine").isNotNull(), F.col("seq"))).alias("found_engine"),
    )
    runs = events.where(run).groupBy("path").agg(F.max("seq").alias("r"))
    later = events.join(runs, "path").where("kind = 'adopt' AND engine IS NOT NULL AND seq > r").groupBy("path").agg(F.min_by("engine", "seq").alias("later_engine"))
    old = transcripts.withColumn("__old", F.lit(True))
    j = old.join(e, "path", "full_outer").join(later, "path", "left")
    ran, was, touched = F.col("run_seq").isNotNull(), F.col("__old").isNotNull(), F.col("n_events").isNotNull()
    return j.select(
        "path", *[F.when(ran, F.col(f"run_{c}")).when(was, F.col(c)).otherwise(F.col(f"first_{c}")).alias(c) for c in ("recording_id",)],
        F.when(ran, F.coalesce("run_engine", "later_engine")).otherwise(F.coalesce("engine", "found_engine")).alias("engine"),
        F.when(ran, F.col("run_language")).otherwise(F.col("language")).alias("language"), F.when(touched, F.col("new_model")).otherwise(F.col("model")).alias("model"),
        F.when(ran, F.col("run_finished_at")).when(was, F.col("finished_at")).otherwise(F.col("first_finished_at")).alias("finished_at"),
    )


def relinked(recordings: DataFrame, transcripts: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings, transcripts (path, recording_id) and outcomes (id, outcome) after files were picked for recordings.

    picks: (id, path, content_id), one for each recording. A recording whose contents are others refuses (not the same); one whose contents stand
    under another row joins that row (joined: its transcripts go there, it goes); else it is at the path now (linked).
    """
    found = recordings.select("id", F.col("content_id").alias("own"))
    other = recordings.where("content_id IS NOT NULL").groupBy("content_id").agg(F.min("id").alias("known"))
    p = picks.join(found, "id", "left").join(other, "content_id", "left")
    same = F.col("own").isNull() | (F.col("own") == F.col("content_id"))
    outcome = F.when(F.col("there").isNull(), "no such recording").when(~same, "not the same").when(F.col("known").isNotNull() & (F.col("known") != F.col("id")), "joined").otherwise("linked")
    p = p.join(recordings.select("id", F.lit(True).alias("there")), "id", "left").withColumn("outcome", outcome)
    joined = p.where("outcome = 'joined'").select(F.col("id").alias("recording_id"), "known")
    moved = transcripts.join(joined, "recording_id", "left").select("path", F.coalesce("known", "recording_id").alias("recording_id"))
    target = p.where("outcome IN ('joined', 'linked')").select(F.when(F.col("outcome") == "joined", F.col("known")).otherwise(F.col("id")).alias("id"), F.col("path").alias("to"), F.col("content_id").alias("picked"), F.col("id").alias("by"))
    target = target.groupBy("id").agg(F.max_by("to", "by").alias("to"), F.first("picked").alias("picked"))
    r = recordings.join(joined.select(F.col("recording_id").alias("id")), "id", "left_anti").join(target, "id", "left")
    r = r.select("id", F.coalesce("to", "path").alias("path"), F.coalesce("content_id", "picked").alias("content_id"), F.when(F.col("to").isNotNull(), F.lit(False)).otherwise(F.col("missing")).alias("missing"))
    return r, moved, p.select("id", "outcome")
