"""The document workflow from end to end: import, translate, polish, review, export, status and the term base.

A state folder holds ``projects`` (JSON, a folder per version, of which the newest that was committed counts) and
``chapters`` (JSON, a folder per project, replaced whole), and the append-only
tables ``events`` (of terms), ``usage`` and ``log``. Each step reads snapshots, plans with the operators, calls the
model once per batch, and writes what changed; what is done already is not done again, so a step that was cut off is
simply run again. A step that writes holds its project's lock, a file that only one of two runs can make; ``unlock``
removes one that a lost run left behind.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.hashing import rfc3339, run_id
from quire.model import Client, Mock, call_model
from quire.operators import analysis, conflicts, export, packing, progress, prompts, review, revisions, segment, terms
from quire.operators.common import settled
from quire.sources import epub, state, text

STATES = "id, ordinal, source, target, target_before_polish, polish_status, kind, status, source_hash, meta".split(", ")


class Workflow:
    def __init__(self, spark: SparkSession, folder: str, client: Client | None = None, options: state.Options | None = None):
        self.spark, self.folder, self.client, self.options = spark, folder.rstrip("/"), client or Mock(), (options or state.Options()).checked()

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _at(self, name: str):
        """The file system and path of a table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._at(name)
        return files.exists(path)

    def _versions(self, name: str) -> list[str]:
        """Committed versions of a table that is replaced as a whole, oldest first."""
        if not self._exists(name):
            return []
        files, path = self._at(name)
        found = sorted(x.getPath().getName() for x in files.listStatus(path) if x.isDirectory())
        return [f"{name}/{v}" for v in found if self._exists(f"{name}/{v}/_SUCCESS")]

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Write a new version; earlier ones go once it is committed, so a reader always finds a whole table."""
        old = self._versions(name)
        rows.write.json(self._path(f"{name}/{time.time_ns():020d}"))
        for version in old:
            files, path = self._at(version)
            files.delete(path, True)

    def _table(self, name: str, schema: str) -> DataFrame:
        """An append-only table; empty before its first row."""
        return self.spark.read.schema(schema).json(self._path(name)) if self._exists(name) else self.spark.createDataFrame([], schema)

    def projects(self) -> DataFrame:
        newest = self._versions("projects")[-1:]
        return self._table(newest[0] if newest else "projects", state.PROJECT).where("id is not null")

    def chapters(self, project_id: str) -> DataFrame:
        rows = state.read_chapters(self.spark, self._path("chapters")) if self._exists("chapters") else self.spark.createDataFrame([], state.CHAPTER).withColumn("place", F.lit(0).cast("long"))
        return rows.where(F.col("project_id") == project_id)

    def segments(self, project_id: str) -> DataFrame:
        return state.segments_of(self.chapters(project_id))

    def log(self, event: str, **details: str) -> None:
        row = self.spark.range(1).select(F.concat_ws("\t", rfc3339(F.current_timestamp()), F.lit(event), F.to_json(F.create_map(*[F.lit(str(x)) for kv in details.items() for x in kv]) if details else F.expr("named_struct()"))).alias("value"))
        row.coalesce(1).write.mode("append").text(self._path("log"))

    @contextmanager
    def _locked(self, project_id: str):
        """Only one run at a time writes a project; raises where another one does."""
        files, path = self._at(f"locks/{project_id}")
        if not files.createNewFile(path):
            raise ValueError(f"project {project_id} is in use")
        try:
            yield
        finally:
            files.delete(path, False)

    def unlock(self, project_id: str) -> None:
        files, path = self._at(f"locks/{project_id}")
        files.delete(path, False)

    def _save(self, project_id: str, chapters: DataFrame) -> None:
        """Replace a project's chapters, which may have been read from there, and its progress."""
        chapters = settled(chapters.select("project_id", "id", "title", "target_title", "status", "meta", "segments"))
        state.write_chapters(chapters, self._path("chapters"))
        heads = chapters.select("project_id", F.col("id").alias("chapter_id"), "target_title")
        rows = chapters.select("project_id", F.col("id").alias("chapter_id"), F.explode("segments").alias("s")).select("project_id", "chapter_id", "s.*")
        done = progress.project_progress(progress.chapter_status(heads, rows, ["project_id", "chapter_id"]), ["project_id"])
        fresh = done.select(F.col("project_id").alias("id"), F.col("chapters_completed").alias("__n"), F.col("status").alias("__status"))
        old = self.projects().join(fresh, "id", "left")
        new = old.select("id", "source_file", "source_path", "source_language", F.coalesce("__status", "status").alias("status"), "chapters_total", F.coalesce("__n", "chapters_completed").alias("chapters_completed"), "created_at", F.when(F.col("__n").isNotNull(), rfc3339(F.current_timestamp())).otherwise(F.col("updated_at")).alias("updated_at"))
        self._replace("projects", settled(new))

    def _nested(self, rows: DataFrame, chapters: DataFrame) -> DataFrame:
        """Chapters with the segments of ``rows`` (chapter_id and STATES) in order."""
        own = F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*STATES).alias("s"))))
        found = rows.groupBy("chapter_id").agg(F.transform(own, lambda x: x["s"]).alias("segments"))
        kind = chapters.schema["segments"].dataType
        return chapters.drop("segments").join(found, chapters["id"] == found["chapter_id"], "left").drop("chapter_id").withColumn("segments", F.coalesce(F.col("segments").cast(kind), F.array().cast(kind)))

    def add(self, path: str) -> list[str]:
        """Import a .txt or .epub file, or a folder of them; returns the ids of all its books. A book that is known by its content is left as it is."""
        files = text.read_files(self.spark, path)
        plain = text.segments(files, self.options.max_segment_chars).select("project_id", "chapter", "chapter_id", "chapter_title", "ordinal", "id", "kind", "source", "source_hash")
        archives = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(path)
        archives = archives.select("path", "content", F.sha2("content", 256).alias("project_id"))
        books = epub.books(archives, "project_id").where("error is null")
        blocks = epub.blocks(books, "project_id")
        marked = segment.segments(blocks, ["project_id"], ["place"], self.options.max_segment_chars).select(plain.columns)
        names = files.select("project_id", "path").unionByName(archives.select("project_id", "path"))
        rows = settled(plain.unionByName(marked))
        now = rfc3339(F.current_timestamp())
        counts = rows.groupBy("project_id").agg(F.countDistinct("chapter").alias("n"))
        projects = names.dropDuplicates(["project_id"]).join(counts, "project_id").select(
            F.col("project_id").alias("id"), F.regexp_extract("path", r"[^/]*$", 0).alias("source_file"), F.col("path").alias("source_path"), F.lit(self.options.source_language).cast("string").alias("source_language"),
            F.lit("initialized").alias("status"), F.col("n").alias("chapters_total"), F.lit(0).cast("long").alias("chapters_completed"), now.alias("created_at"), now.alias("updated_at"),
        )
        new = settled(state.initialized(self.projects(), projects))
        none = F.lit(None).cast("string")
        one = F.struct("id", F.col("ordinal").cast("int").alias("ordinal"), "source", none.alias("target"), none.alias("target_before_polish"), none.alias("polish_status"), "kind", F.lit("pending").alias("status"), "source_hash", F.lit("{}").alias("meta"))
        own = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", one.alias("s")))), lambda x: x["s"])
        fresh = rows.join(new.select(F.col("id").alias("project_id")), "project_id", "left_semi")
        found = fresh.groupBy("project_id", "chapter_id", "chapter_title").agg(own.alias("segments"))
        state.write_chapters(found.select("project_id", F.col("chapter_id").alias("id"), F.col("chapter_title").alias("title"), none.alias("target_title"), F.lit("pending").alias("status"), F.lit("{}").alias("meta"), "segments"), self._path("chapters"))
        self._replace("projects", settled(self.projects().unionByName(new.select(self.projects().columns))))
        self.log("initialized", path=path)
        return sorted(r.id for r in projects.select("id").collect())

    def _answers(self, batches: DataFrame, task: str, ids: str, texts: str) -> DataFrame:
        """(id, answer) for the items of batches; usage is appended on the way."""
        about = [c for c in ("context",) if c in batches.columns]
        found = settled(call_model(batches.select(ids, texts, *about), self.client, task, texts, self.options.max_retries, *about))
        usage = found.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).select(F.lit(task).alias("stage"), "input_tokens", "output_tokens", rfc3339(F.current_timestamp()).alias("recorded_at"))
        usage.write.mode("append").json(self._path("usage"))
        return found.select(F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col("answers").alias("answer"))).alias("x")).select("x.id", "x.answer").where("answer is not null")

    def _batched(self, rows: DataFrame, keep: Column, value: str, pack_all: bool) -> DataFrame:
        """Batches (ids, texts) of a project's segments within the budget, never across chapters."""
        items = rows.select("chapter_id", "ordinal", "id", F.col(value).alias("value"), F.length("source").alias("size"), keep.alias("keep"))
        packed = packing.pack(items if pack_all else items.where("keep"), ["chapter_id"], "ordinal", "size", self.options.max_batch_chars).where("keep")
        own = F.sort_array(F.collect_list(F.struct("ordinal", "id", "value")))
        return packed.groupBy("chapter_id", "batch").agg(F.transform(own, lambda x: x["id"]).alias("ids"), F.transform(own, lambda x: x["value"]).alias("texts"))

    def _told(self, rows: DataFrame, batches: DataFrame) -> DataFrame:
        """Batches with their contexts, for clients that want them."""
        if not getattr(self.client, "wants_context", False):
            return batches
        batches = settled(batches)
        at = batches.select("batch", F.explode("ids").alias("id"))
        own = self.terms().where("not deleted").select("source", "target", F.array().cast("array<string>").alias("aliases"), "policy")
        marked = rows.join(at, "id", "left").withColumn("book", F.lit("own"))
        found = prompts.contexts(marked, ["book"], ["place", "chapter_id"], "ordinal", settled(own), budget=self.options.recent_context_chars, source_language=F.lit(self.options.source_language).cast("string"))
        return batches.join(found.select("chapter_id", "batch", "context"), ["chapter_id", "batch"], "left")

    def translate(self, project_id: str, chapter: int | None = None) -> int:
        """Translate what is open, then titles of finished chapters; returns how many segments still lack a translation."""
        with self._locked(project_id):
            return self._translate(project_id, chapter)

    def _translate(self, project_id: str, chapter: int | None) -> int:
        chapters = self.chapters(project_id)
        rows = self.segments(project_id)
        open_ = revisions.open_segment("target", "target_before_polish")
        wanted = rows if chapter is None else rows.where(F.col("place") == chapter + 1)
        answers = self._answers(self._told(rows, self._batched(wanted, open_, "source", True)), "translate", "ids", "texts")
        joined = rows.join(answers, "id", "left")
        done = joined.withColumns({"target": F.coalesce("answer", "target"), "target_before_polish": F.coalesce("answer", "target_before_polish"), "status": F.when(F.col("answer").isNotNull(), "translated").otherwise(F.col("status"))})
        nested = settled(self._nested(done.select("chapter_id", *STATES), chapters))
        body = F.forall("segments", lambda s: (s["status"] == "translated") & s["target"].isNotNull())
        heads = nested.select("id", F.col("title").alias("source"), F.col("place").alias("ordinal"), F.lit("titles").alias("chapter_id"), (F.col("target_title").isNull() & body).alias("open"))
        titles = self._answers(self._batched(heads, F.col("open"), "source", True), "title", "ids", "texts").select("id", F.col("answer").alias("__title"))
        new = nested.join(titles, "id", "left").withColumn("target_title", F.coalesce("target_title", "__title")).withColumn("status", F.when(body, "translated").otherwise("pending")).drop("__title")
        self._save(project_id, new)
        left = self.segments(project_id).where("target is null").count()
        self.log("translated", project=project_id, left=str(left))
        return left

    def polish(self, project_id: str) -> int:
        """Polish frozen drafts that are eligible; returns how many segments failed."""
        with self._locked(project_id):
            return self._polish(project_id)

    def _polish(self, project_id: str) -> int:
        rows, chapters = self.segments(project_id), self.chapters(project_id)
        fit = revisions.polish_eligible(revisions.is_protected("meta"), F.col("polish_status"), F.col("target_before_polish"))
        batches = settled(self._batched(rows, fit, "target_before_polish", False))
        answers = self._answers(batches, "polish", "ids", "texts")
        asked = batches.select(F.explode("ids").alias("segment_id")).join(answers.select(F.col("id").alias("segment_id"), "answer"), "segment_id", "left")
        results = asked.select("segment_id", F.col("answer").isNotNull().alias("ok"), F.col("answer").alias("text"))
        held = rows.withColumn("protected", revisions.is_protected("meta")).withColumnRenamed("id", "segment_id")
        new = revisions.applied_batches(held, results).withColumnRenamed("segment_id", "id")
        self._save(project_id, self._nested(new.select("chapter_id", *STATES), chapters))
        return self.segments(project_id).where("polish_status = 'failed'").count()

    def _synced(self, rows: DataFrame, chapters: DataFrame, new: DataFrame) -> DataFrame:
        """(chapter_id, __title): titles of chapters whose heading was rewritten (ids of ``new``), and only those."""
        named = chapters.select(F.col("id").alias("chapter_id"), "title", "target_title")
        heads = rows.where("kind = 'heading'").join(new.select("id"), "id", "left_semi")
        same = revisions.synced_headings(heads.select("chapter_id", "id", "kind", "source"), named, ["chapter_id"]).select("chapter_id", "id")
        return same.join(rows.select("id", F.col("target").alias("__title")), "id").groupBy("chapter_id").agg(F.min_by("__title", "id").alias("__title"))

    def _store(self, project_id: str, rows: DataFrame, chapters: DataFrame, new: DataFrame) -> None:
        """Save rewritten segments; titles follow the headings among ``new`` (id)."""
        titles = self._synced(rows, chapters, new).withColumnRenamed("chapter_id", "id")
        named = chapters.join(titles, "id", "left").withColumn("target_title", F.coalesce("__title", "target_title")).drop("__title")
        self._save(project_id, self._nested(rows.select("chapter_id", *STATES), named))

    def retranslate(self, project_id: str, source: str) -> int:
        """Translate anew every title and segment that the term ``source`` occurs in; returns how many failed.

        The old text stays in the history, and where a call fails or a hand has edited, it stays as it is and the error
        is noted. A heading follows its chapter's title, and the title its heading.
        """
        with self._locked(project_id):
            rows, chapters = settled(self.segments(project_id)), self.chapters(project_id)
            term = self.spark.createDataFrame([(project_id, source)], "project_id string, source string")
            titles = chapters.select("project_id", F.col("id").alias("chapter_id"), "title", "target_title")
            hit = settled(terms.impact(titles, rows, ["project_id"], term).select("id", "chapter_id", "kind").distinct())
            body = hit.where("kind <> 'title'").select("id", F.lit(True).alias("__hit"))
            marked = rows.join(body, "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
            batches = self._told(rows, self._batched(marked, F.col("__hit"), "source", False))
            answers = self._answers(batches, "translate", "ids", "texts").select("id", F.col("answer").alias("__new"))
            heads = chapters.select("id", F.col("title").alias("source"), F.col("place").alias("ordinal"), F.lit("titles").alias("chapter_id")).join(hit.where("kind = 'title'").select(F.col("chapter_id").alias("id")), "id", "left_semi")
            named = settled(self._answers(self._batched(heads, F.lit(True), "source", False), "title", "ids", "texts")).select(F.col("id").alias("chapter_id"), F.col("answer").alias("target_title"))
            follow = revisions.synced_headings(rows.select("chapter_id", "id", "kind", "source"), titles.drop("target_title").join(named, "chapter_id"), ["chapter_id"]).select("id", F.col("target").alias("__follow"))
            asked = marked.join(answers, "id", "left").join(follow, "id", "left")
            kind = F.when(F.col("__hit") | F.col("__follow").isNotNull(), "retranslation")
            done = asked.withColumn("__x", revisions.rewritten("target", "target_before_polish", "polish_status", "meta", F.coalesce("__follow", "__new"), kind))
            done = settled(done.withColumns({"target": F.col("__x.target"), "target_before_polish": F.col("__x.draft"), "polish_status": F.col("__x.polish_status"), "meta": F.col("__x.meta"), "status": F.when(F.col("__x.changed"), "translated").otherwise(F.col("status"))}))
            fresh = chapters.join(named.select(F.col("chapter_id").alias("id"), F.col("target_title").alias("__new_title")), "id", "left").withColumn("target_title", F.coalesce("__new_title", "target_title")).drop("__new_title")
            failed = done.where("__x.error is not null").count() + heads.join(named, F.col("id") == named["chapter_id"], "left_anti").count()
            self._store(project_id, done, fresh, done.where("__x.changed and __follow is null"))
        self.log("retranslated", project=project_id, term=source, failed=str(failed))
        return failed

    def detail(self, project_id: str, segment_id: str) -> dict:
        """A segment with its revisions, the number of the current one, and the suggestion that was made last."""
        found = self.segments(project_id).where(F.col("id") == segment_id).first()
        if found is None:
            raise ValueError(f"no segment {segment_id}")
        meta = revisions.held(found.meta)
        history = revisions.versions(found.target, found.target_before_polish, meta)
        return {"segment": found.asDict(True), "revisions": history, "revision": history[-1]["id"] if history else 0, "preview": meta.get(revisions.PREVIEW)}

    def _checked(self, project_id: str, segment_id: str, revision: int, target: str | None) -> dict:
        own = self.detail(project_id, segment_id)
        if (own["revision"], own["segment"]["target"]) != (revision, target):
            raise ValueError("the translation was changed meanwhile")
        return own

    def save(self, project_id: str, segment_id: str, revision: int, expected: str | None, target: str | None = None, restore: int | None = None, adopt: str | None = None) -> dict:
        """Edit one segment by hand: a text, a revision to go back to, or a suggestion (by id). Raises unless ``revision`` and ``expected`` are the current ones; returns the new detail."""
        with self._locked(project_id):
            own = self._checked(project_id, segment_id, revision, expected)
            kind, model = "manual", None
            if restore is not None:
                kind, target = "restore", next((r["target"] for r in own["revisions"] if r["id"] == restore), None)
                if target is None:
                    raise ValueError(f"no revision {restore}")
            elif adopt is not None:
                seen = own["preview"]
                if not seen or seen["id"] != adopt or (seen["base_revision"], seen["base_target"]) != (revision, expected):
                    raise ValueError("the suggestion is gone or was replaced")
                kind, target, model = "adopt", seen["target"], seen.get("model")
            old = own["segment"]
            new = revisions.rewrite(old["target"], old["target_before_polish"], old["polish_status"], old["meta"], target, kind, model)
            if new["error"]:
                raise ValueError(new["error"])
            if not new["changed"]:
                return own
            self._put(project_id, segment_id, {"target": new["target"], "target_before_polish": new["draft"], "polish_status": new["polish_status"], "meta": new["meta"], "status": "translated"})
        self.log("translation_edited", project=project_id, segment=segment_id, kind=kind)
        return self.detail(project_id, segment_id)

    def _put(self, project_id: str, segment_id: str, values: dict[str, str | None]) -> None:
        """Set columns of one segment."""
        here = F.col("id") == segment_id
        rows = self.segments(project_id).withColumns({c: F.when(here, F.lit(v).cast("string")).otherwise(F.col(c)) for c, v in values.items()})
        changed = rows.where(here) if "target" in values else rows.limit(0)
        self._store(project_id, rows, self.chapters(project_id), changed)

    def preview(self, project_id: str, segment_id: str) -> dict:
        """Ask for another translation of one segment and keep it as a suggestion, which ``save`` adopts; returns the new detail."""
        with self._locked(project_id):
            own = self.detail(project_id, segment_id)
            if own["segment"]["target"] is None:
                raise ValueError("the segment is not translated")
            rows = self.segments(project_id)
            batches = self._told(rows, self._batched(rows.where(F.col("id") == segment_id), F.lit(True), "source", False))
            answer = self._answers(batches, "translate", "ids", "texts").first()
            if answer is None:
                raise ValueError("the model gave no answer")
            seen = {"id": uuid.uuid4().hex, "target": answer.answer, "base_revision": own["revision"], "base_target": own["segment"]["target"], "model": None}
            meta = revisions.held(own["segment"]["meta"]) | {revisions.PREVIEW: seen}
            self._put(project_id, segment_id, {"meta": json.dumps(meta, ensure_ascii=False)})
        return self.detail(project_id, segment_id)

    def extract(self, project_id: str) -> int:
        """Extract terms from the translated segments of each batch, unless just these were looked at before, and record them as term events; returns how many were found."""
        with self._locked(project_id):
            pairs = self.segments(project_id).withColumn("both", F.to_json(F.struct("source", "target")))
            batches = self._batched(pairs, revisions.complete(), "both", True).withColumn("batch_key", F.array_join("ids", "|"))
            seen = self._table("extracted", "project_id string, chapter_id string, batch_key string").where(F.col("project_id") == project_id)
            left = batches.join(seen, ["chapter_id", "batch_key"], "left_anti")
            side = lambda name: F.array_join(F.transform("texts", lambda t: F.get_json_object(t, f"$.{name}")), "\n").alias(f"{name}_text")
            left = settled(left.select("chapter_id", "batch_key", side("source"), side("target")))
            place = self.chapters(project_id).select(F.col("id").alias("chapter_id"), "place")
            last = self._table("events", conflicts.EVENT).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
            found = analysis.extractions(left, self.client, ["chapter_id", "batch_key"], self.options.max_retries).join(place, "chapter_id").orderBy("place", "batch_key", "source")
            events = settled(analysis.as_events(found, F.lit(last + 1) + F.monotonically_increasing_id(), F.col("place") - 1))
            self.record_terms(events)
            left.select(F.lit(project_id).alias("project_id"), "chapter_id", "batch_key").write.mode("append").json(self._path("extracted"))
            return events.count()

    def terms(self) -> DataFrame:
        """The term base after all its events."""
        return conflicts.fold_terms(self._table("events", conflicts.EVENT))

    def record_terms(self, events: DataFrame) -> None:
        """Append term events (EVENT)."""
        events.write.mode("append").json(self._path("events"))

    def resolve(self, source: str, target: str) -> None:
        last = self._table("events", conflicts.EVENT).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self.record_terms(self.spark.createDataFrame([(source, last + 1, "resolve", target, None, None)], conflicts.EVENT))

    def review(self, project_id: str) -> tuple[str, DataFrame]:
        """(run id, issues), both written below ``reviews``."""
        rows = self.segments(project_id)
        own = self.terms().where("not deleted").select("source", "target")
        found = review.report(review.untranslated(rows, []).unionByName(review.terminology(rows, own, [])), [])
        run = self.spark.range(1).select(run_id("review", F.current_timestamp())).first()[0]
        found.write.mode("errorifexists").json(self._path(f"reviews/{project_id}/{run}"))
        return run, found

    def export(self, project_id: str, bilingual: bool = False, source_first: bool = False, kind: str = "txt") -> DataFrame:
        """(project_id, content) of a finished book, as text or as an archive; raises on the first title or segment that cannot be exported."""
        chapters, rows = self.chapters(project_id), self.segments(project_id)
        heads = chapters.select("project_id", F.col("place").alias("chapter"), "target_title")
        body = rows.withColumn("chapter", F.col("place"))
        bad = export.first_violation(export.violations(heads, body, ["project_id"]), ["project_id"]).first()
        if bad is not None:
            raise ValueError(f"chapter {bad.chapter}, segment {bad.ordinal}: {bad.reason}")
        from quire.functions.punctuation import normalized

        titled = body.join(chapters.select(F.col("id").alias("chapter_id"), normalized("target_title").alias("title")), "chapter_id").withColumn("target", normalized("target"))
        shown = export.without_title(titled.withColumn("target_title", F.col("title")), ["project_id", "chapter"], "ordinal")
        if kind == "txt":
            return export.plain_text(shown, ["project_id"], bilingual, source_first).select("project_id", F.encode("text", "UTF-8").alias("content"))
        texts = export.paragraph_texts(bilingual, source_first, F.col("kind"), F.col("source"), F.col("target"))
        name = self.projects().select(F.col("id").alias("project_id"), F.col("source_file").alias("book_title"))
        made = shown.join(name, "project_id").select("project_id", "book_title", "chapter", F.col("title").alias("chapter_title"), "ordinal", texts.alias("texts"))
        return epub.generate(made, "project_id", self.options.target_language)

    def status(self, project_id: str) -> DataFrame:
        """(chapter_id, title, translated, total) in order."""
        counts = progress.by_chapter(self.segments(project_id), ["chapter_id"])
        rows = self.chapters(project_id).select(F.col("id").alias("chapter_id"), "place", "title").join(counts, "chapter_id", "left")
        return rows.orderBy("place").select("chapter_id", "title", F.coalesce("translated", F.lit(0)).alias("translated"), F.coalesce("total", F.lit(0)).alias("total"))

    def delete(self, project_id: str) -> None:
        """Remove a project and its chapters; logs and usage stay."""
        state.by_id(self.projects(), project_id)
        with self._locked(project_id):
            self._delete(project_id)

    def _delete(self, project_id: str) -> None:
        kept = settled(self.projects().where(F.col("id") != project_id))
        self._replace("projects", kept)
        files, path = self._at(f"chapters/project_id={project_id}")
        files.delete(path, True)
