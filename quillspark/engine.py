"""All that an upload, a review and a report need, over tables in one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions import text as T
from .operators import advice, commands, enrich, reconcile, render, review
from .plans import structure
from .plans.stage import staged
from .sources import docx_out, files
from .sources.store import Store

#: A threshold above this one approves nothing by itself.
NEVER = 1.0


class NotReady(ValueError):
    """A document that still waits for review can't be rendered."""


class Engine:
    """Documents in, reviewed records and finished documents out; each method is a plan over whole tables, for one document or all of them."""

    def __init__(self, spark: SparkSession, folder: str, this_year: int, classify: Callable | None = None, write: Callable | None = None):
        self.spark, self.store, self.this_year, self.classify, self.write = spark, Store(spark, folder), this_year, classify, write

    # documents

    def upload(self, path: str, readers: dict | None = None) -> DataFrame:
        """Reads the files under ``path`` and structures those that give text: (doc_id, document, text, error)."""
        read = files.read_files(self.spark, path, readers)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        return self.ingest(read.select(F.sha2("path", 256).alias("doc_id"), name.alias("document"), "text", "error"))

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Structures ``docs(doc_id, text[, document, error])``: their items replace those they had."""
        rows = docs if "error" in docs.columns else docs.withColumn("error", F.lit(None).cast("string"))
        rows = staged(rows)
        self.store.replace("documents", rows, ["doc_id"])
        readable = rows.where("error is null and text is not null")
        made = structure.processed(readable, self.this_year, self.mappings(), self.threshold(), self.classify, self.write)
        profiles = self.store.read("profiles")
        self.store.replace("items", staged(made if profiles is None else self._filled(made, profiles)), ["doc_id"])
        self._log(rows, "uploaded")
        return rows

    def _filled(self, items: DataFrame, profiles: DataFrame) -> DataFrame:
        """Items with the saved profile of their owner: contact data take the place of what was read, lists come where their section is empty."""
        items = staged(items)
        mine = enrich.saved_profiles(items, profiles).select("doc_id", "email", "phone", "job_title", "links", "memberships")
        added = reconcile.prefill(items, mine).where("origin = 'profile'")
        single = items.join(added.where("section in ('email', 'contact_info', 'job_title')").select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
        none = F.array().cast("array<string>")
        new = added.select("doc_id", (F.pmod(F.xxhash64("section", "value"), F.lit(1 << 30)) + (1 << 43)).alias("item_ord"), "section", F.create_map(F.lit("value"), F.col("value")).alias("fields"), F.col("value").alias("raw_text"), F.lit(1.0).alias("confidence"), none.alias("flags"), F.lit("approved").alias("status"), F.array(F.lit("profile")).alias("actions"))
        return single.select(*items.columns).unionByName(review.stored(new).select(*items.columns))

    def documents(self) -> DataFrame | None:
        return self.store.listed("documents")

    def source(self, doc_id: object) -> DataFrame | None:
        return self.store.get("documents", doc_id)

    # items

    def items(self, doc_id: object | None = None) -> DataFrame:
        """Items with the line that each leaves in the finished document, in section order."""
        rows = self.store.read("items")
        rows = rows if doc_id is None else rows.where(F.col("doc_id") == F.lit(doc_id))
        place = F.array_position(F.array(*map(F.lit, vocab.SECTION_KEYS)), F.col("section"))
        return rows.withColumn("display", render.item_line()).orderBy("doc_id", place, "item_ord")

    def patch(self, edits: DataFrame) -> DataFrame:
        return self._changed(commands.patch(self.store.read("items"), edits), "patched")

    def bulk_status(self, status: str, section: str | None = None, band: str | None = None, pending_only: bool = True) -> DataFrame:
        return self._changed(commands.bulk_status(self.store.read("items"), status, section, band, pending_only), f"bulk_{status}")

    def command(self, said: DataFrame) -> DataFrame:
        """Carries out ``said(doc_id, text)``, one for a document: (doc_id, said) of what was done, or why nothing was."""
        parsed = staged(commands.answered(said))
        items = self.store.read("items")
        done = staged(commands.confirmations(items, parsed))
        self._changed(commands.applied(items.drop("item_id", "band"), parsed), "command", fresh=True)
        return done.unionByName(parsed.where("answer is not null").select("doc_id", F.col("answer").alias("said")))

    def delete_items(self, gone: DataFrame) -> DataFrame | None:
        return self.store.delete("items", gone)

    def split(self, splits: DataFrame) -> DataFrame:
        return self._changed(advice.split_items(self.store.read("items").drop("item_id", "band"), splits), "split", fresh=True)

    def _changed(self, items: DataFrame, action: str, fresh: bool = False) -> DataFrame:
        out = self.store.write("items", staged(review.stored(items) if fresh else items.withColumn("band", T.band(F.col("confidence")))))
        self._log(out.select("doc_id").distinct(), action)
        return out

    # what is taught and set

    def mappings(self) -> DataFrame | None:
        return self.store.read("mappings")

    def teach(self, mappings: DataFrame) -> DataFrame:
        """``mappings(heading, section)``: headings that name a section from now on."""
        return self.store.upsert("mappings", mappings.where(F.col("section").isin(vocab.SECTION_KEYS)).select(F.trim("heading").alias("heading"), "section"))

    def forget(self, headings: DataFrame) -> DataFrame | None:
        return self.store.delete("mappings", headings)

    def threshold(self) -> float:
        """The least confidence that approves an item by itself; above 1 nothing is."""
        rows = self.store.get("settings", "approve_from")
        row = None if rows is None else rows.first()
        return float(row["value"]) if row else vocab.APPROVE

    def set_threshold(self, value: float) -> None:
        if not value > 0:
            raise ValueError("a threshold is greater than 0")
        self.store.upsert("settings", self.spark.createDataFrame([("approve_from", str(value))], "key string, value string"))

    # profiles

    def save_profiles(self) -> DataFrame:
        """A profile for each owner of a document."""
        return self.store.upsert("profiles", enrich.seed_profiles(self.store.read("items").where("status <> 'rejected'")))

    def profiles(self) -> DataFrame | None:
        return self.store.listed("profiles", F.col("full_name"))

    # reports

    def report(self, doc_id: object | None = None) -> DataFrame:
        """A row for each document: counts, coverage, readiness, and what is to be said of single items."""
        rows = self.store.read("items")
        rows = staged(rows if doc_id is None else rows.where(F.col("doc_id") == F.lit(doc_id)))
        return review.summary_report(rows).join(review.remarks(rows), "doc_id")

    def sections(self, doc_id: object | None = None) -> DataFrame:
        rows = self.store.read("items")
        return review.section_report(rows if doc_id is None else rows.where(F.col("doc_id") == F.lit(doc_id)), vocab.sections(self.spark))

    def unmapped_headings(self) -> DataFrame:
        rows = self.store.read("items").where("section = 'unmapped'").select("doc_id", F.col("fields")["context"].alias("context"), F.col("fields")["value"].alias("value"), "item_ord")
        return review.unmapped_headings(rows, self.mappings())

    def suggestions(self) -> DataFrame:
        rows = self.store.read("items").where("section <> 'unmapped' and fields['context'] is not null").select("doc_id", "section", F.col("fields")["context"].alias("context"), F.col("raw_text").alias("value"), "item_ord")
        return review.suggested_mappings(rows, self.mappings())

    def audit(self) -> DataFrame | None:
        return self.store.listed("audit", F.col("at"))

    def _log(self, docs: DataFrame, action: str) -> None:
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(action).alias("action"), F.current_timestamp().alias("at"))
        self.store.append("audit", staged(rows.withColumn("event_id", F.sha2(F.concat_ws("|", "doc_id", "action", F.col("at").cast("string")), 256))))

    # finished documents

    def lines(self, doc_id: object | None = None) -> DataFrame:
        """Lines of the finished documents, letterhead first."""
        rows = self.store.read("items")
        rows = rows if doc_id is None else rows.where(F.col("doc_id") == F.lit(doc_id))
        return render.letterhead_lines(rows).unionByName(render.rendered(rows))

    def generate(self, doc_id: object) -> bytes:
        """The finished document as a file; refused while anything waits for review."""
        state = self.report(doc_id).first()
        if state is None or not state["ready"]:
            raise NotReady("items wait for review")
        row = docx_out.documents(self.lines(doc_id)).first()
        if row is None or row["error"] is not None:
            raise ValueError("the document can't be read again" if row else "nothing is approved")
        return bytes(row["content"])
