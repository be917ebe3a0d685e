"""Action tables for reorganising a catalog.  Nothing is moved."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import names, paths, templates
from shelfmark.functions.hashing import stable_id
from shelfmark.functions.rule_tables import CATEGORY_TEMPLATES
from shelfmark.functions.scale import HOT_ROWS_MIN, number_rows
from shelfmark.operators.dedup import redundant_copies
from shelfmark.operators.flags import clock, is_movable, movable

ROOT = "/Repository"
PATH_LIMIT = 260
SPACE_MARGIN = 1.1


def action_rows(df: DataFrame, target: Column, rule: Column, reason: Column) -> DataFrame:
    """The action schema, ids derived from source, rule and target."""
    return df.select(
        stable_id("path", rule, target).alias("action_id"),
        "file_id",
        F.col("path").alias("source_path"),
        target.alias("target_path"),
        F.lit("move").alias("action_type"),
        rule.alias("rule_id"),
        reason.alias("reason"),
        F.col("size_bytes").alias("file_size"),
    )


def _quarantine(group: Column, as_of=None) -> tuple[Column, Column, Column]:
    """(target, rule, reason) of a copy in a duplicate group."""
    target = F.concat(
        F.lit("Quarantine/Duplicates_"), F.date_format(clock(as_of), "yyyy-MM-dd"), F.lit("/"), F.col("name")
    )
    return target, F.lit("duplicate_quarantine"), F.concat(F.lit("Duplicate (group "), group, F.lit(")"))


def quarantine(files: DataFrame, members: DataFrame, as_of=None) -> DataFrame:
    """Every copy but the keeper goes to a dated quarantine folder."""
    return action_rows(redundant_copies(files, members), *_quarantine(F.col("group_id"), as_of))


def category_targets(
    root: str = ROOT, category_templates: Mapping[str, str] = CATEGORY_TEMPLATES, rename: bool = False
) -> Column:
    """Target path by category template; NULL for categories without one."""
    modified = F.col("modified_at")
    project = F.coalesce(F.nullif(paths.project(F.col("path")), F.lit("")), F.lit("General"))
    values = {
        "YYYY": F.date_format(modified, "yyyy"),
        "MM": F.date_format(modified, "MM"),
        "YYYY-MM": F.date_format(modified, "yyyy-MM"),
        "subcategory": F.lit("General"),
        "media_type": F.col("file_category"),
        "project_name": project,
    }
    plain = F.concat(F.lit("Active/"), F.col("file_category"))
    folder = templates.choose(
        F.col("file_category"),
        {c: templates.render_or(t, values, plain) for c, t in category_templates.items()},
    )
    name = F.col("name")
    if rename:
        name = names.conventional_name(
            F.date_format(modified, "yyyy-MM-dd"),
            project,
            F.col("file_category"),
            F.coalesce(names.version(F.col("name")), F.lit("v01")),
            F.col("extension"),
        )
    return F.concat(F.lit(root + "/"), folder, F.lit("/"), name)


def _reorganise(target: Column) -> tuple[Column, Column, Column]:
    category = F.col("file_category")
    return target, F.concat(F.lit("reorganize_"), category), F.concat(F.lit("Reorganize to "), category, F.lit(" structure"))


def reorganise(
    files: DataFrame,
    root: str = ROOT,
    category_templates: Mapping[str, str] = CATEGORY_TEMPLATES,
    rename: bool = False,
    exclude: str = "members",
) -> DataFrame:
    """Files whose category template puts them somewhere else."""
    placed = movable(files, exclude).withColumn("_target", category_targets(root, category_templates, rename))
    elsewhere = F.col("_target").isNotNull() & (F.col("_target") != F.col("path"))
    return action_rows(placed.where(elsewhere), *_reorganise(F.col("_target")))


def _archive(root: str, as_of=None) -> tuple[Column, Column, Column]:
    target = F.concat_ws(
        "/", F.lit(root), F.lit("Archive"), F.col("file_category"), F.date_format(clock(as_of), "yyyy"), F.col("name")
    )
    return target, F.lit("lifecycle_archive"), F.lit("Orphaned file (not accessed recently)")


def archive(files: DataFrame, root: str = ROOT, as_of=None) -> DataFrame:
    """Stale files go to Archive/category/year."""
    return action_rows(files.where("is_orphaned"), *_archive(root, as_of))


def full_plan(
    files: DataFrame,
    members: DataFrame,
    root: str = ROOT,
    as_of=None,
    category_templates: Mapping[str, str] = CATEGORY_TEMPLATES,
    rename: bool = False,
    exclude: str = "members",
) -> DataFrame:
    """Quarantine, reorganisation and archive actions together, in one pass over the files.

    Each file meets the groups it is a copy in (a handful at most) once, and unfolds into
    its actions.
    """
    def action(parts: tuple[Column, Column, Column]) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(parts, ("target", "rule", "reason"), strict=True)])

    copies = members.where(~F.col("is_canonical")).groupBy("file_id").agg(F.collect_list("group_id").alias("_groups"))
    placed = files.join(copies, "file_id", "left").withColumn("_target", category_targets(root, category_templates, rename))
    elsewhere = is_movable(exclude) & F.col("_target").isNotNull() & (F.col("_target") != F.col("path"))
    quarantined = F.transform(F.coalesce("_groups", F.array().cast("array<string>")), lambda g: action(_quarantine(g, as_of)))
    moved = F.array_compact(
        F.array(F.when(elsewhere, action(_reorganise(F.col("_target")))), F.when(F.col("is_orphaned"), action(_archive(root, as_of))))
    )
    unfolded = placed.withColumn("_action", F.explode(F.concat(quarantined, moved)))
    return action_rows(unfolded, F.col("_action.target"), F.col("_action.rule"), F.col("_action.reason"))


def plan_summary(actions: DataFrame) -> DataFrame:
    """Count and bytes per action type, with the plan totals as one more row."""
    return actions.rollup("action_type").agg(
        F.count("*").alias("count"), F.sum("file_size").alias("total_size")
    ).withColumn("action_type", F.coalesce("action_type", F.lit("total")))


def staging(
    files: DataFrame,
    inventory: DataFrame,
    target_root: str = ROOT,
    staging_root: str = "/staging",
    folders: Mapping[str, str] | None = None,
) -> DataFrame:
    """Staged actions mirroring the target tree; existing targets are conflicts.

    A classified category wins over the file category; ``folders`` maps categories to
    folder paths (default: underscores become sub-folders).
    """
    category = F.coalesce("classified_category", "file_category") if "classified_category" in files.columns else F.col("file_category")
    default = F.replace(category, F.lit("_"), F.lit("/"))
    folder = templates.choose(category, {c: F.lit(p) for c, p in folders.items()}) if folders else default
    relative = F.concat(folder, F.lit("/"), F.col("name"))
    planned = (
        movable(files)
        .withColumn("_relative", relative)
        .where(F.col("_relative").isNotNull())
        .withColumn("target_path", F.concat(F.lit(target_root + "/"), F.col("_relative")))
    )
    taken = inventory.select(F.col("path").alias("target_path")).distinct().withColumn("_taken", F.lit(True))
    return planned.join(taken, "target_path", "left").select(
        stable_id("path", "target_path").alias("action_id"),
        "file_id",
        F.col("path").alias("source_path"),
        F.concat(F.lit(staging_root + "/"), F.col("_relative")).alias("staging_path"),
        "target_path",
        F.lit("move").alias("action_type"),
        F.lit("pending").alias("status"),
        F.when(F.col("_taken"), "existing_file").alias("conflict_type"),
        F.lit(None).cast("string").alias("resolution_strategy"),
        F.col("size_bytes").alias("file_size"),
    )


def staging_summary(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count("*").alias("action_count"), F.count_if(F.col("conflict_type").isNotNull()).alias("conflict_count")
    )


def plans_with_counts(plans: DataFrame, actions: DataFrame) -> DataFrame:
    """Plans (also empty ones) with action and conflict counts."""
    counted = actions.groupBy("plan_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("conflict_type").isNotNull()).alias("c")
    )
    return plans.join(counted, "plan_id", "left").select(
        *plans.columns, F.coalesce("n", F.lit(0)).alias("action_count"), F.coalesce("c", F.lit(0)).alias("conflict_count")
    )


def validate_staging(
    actions: DataFrame, inventory: DataFrame, capacity_bytes: int, path_limit: int = PATH_LIMIT
) -> DataFrame:
    """One row of checks: sources present, path lengths, space, open conflicts.

    Required bytes come from the inventory row of each source path.
    """
    sized = inventory.groupBy("path").agg(F.max("size_bytes").alias("bytes"))
    joined = actions.join(sized, actions.source_path == sized.path, "left")
    unresolved = F.col("conflict_type").isNotNull() & F.col("resolution_strategy").isNull()
    checks = joined.agg(
        F.count_if(F.col("path").isNull()).alias("unreadable_sources"),
        F.count_if(F.length("target_path") > path_limit).alias("long_paths"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("required_bytes"),
        F.count_if(unresolved).alias("unresolved_conflicts"),
    )
    enough = F.lit(capacity_bytes) > F.col("required_bytes") * SPACE_MARGIN
    return checks.withColumn("space_ok", enough).withColumn(
        "passed",
        enough
        & (F.col("unreadable_sources") == 0)
        & (F.col("long_paths") == 0)
        & (F.col("unresolved_conflicts") == 0),
    )


# Allowed plan transitions (from, to).
TRANSITIONS = (
    ("draft", "staged"),
    ("staged", "validated"),
    ("validated", "committed"),
    ("draft", "discarded"),
    ("staged", "discarded"),
    ("validated", "discarded"),
)


def plan_history(events: DataFrame) -> DataFrame:
    """Each status event of a plan with the status before it and whether it was legal.

    ``events``: plan_id, seq, status.  Plans have a handful of events, so the window
    per plan stays small.
    """
    w = Window.partitionBy("plan_id").orderBy("seq")
    before = F.lag("status").over(w)
    allowed = F.concat_ws(">", "previous_status", "status").isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
    return events.withColumn("previous_status", before).withColumn(
        "is_valid", F.when(F.col("previous_status").isNull(), F.col("status") == "draft").otherwise(allowed)
    )


def plan_status(events: DataFrame) -> DataFrame:
    """Latest status per plan, and whether every step to it was legal."""
    return plan_history(events).groupBy("plan_id").agg(
        F.max_by("status", "seq").alias("status"), F.bool_and("is_valid").alias("is_valid")
    )


def executable_plans(plans: DataFrame) -> DataFrame:
    """Approved plans that were not executed yet."""
    return plans.where(F.col("approved") & F.col("executed_at").isNull())


def suffixed(path: Column, n: Column) -> Column:
    """``dir/stem_n.ext``."""
    ext = paths.suffix_of_name(paths.name(path))
    return F.concat(F.left(path, F.length(path) - F.length(ext)), F.lit("_"), n.cast("string"), ext)


# Taken numbers ranked at a time, and claimants of one name that meet its intervals in one group.
NUMBERS_A_RANGE = 1 << 15
TURNS_A_BUCKET = 256


def _taken_numbers(taken: DataFrame, on_disk: DataFrame | None) -> DataFrame:
    """``target_path, _number``, distinct: ``/a/x_2.pdf`` is number 2 of ``/a/x.pdf``, the name itself on disk is number 0."""
    path = F.col("resolved_path")
    ext = paths.suffix_of_name(paths.name(path))
    stem = F.left(path, F.length(path) - F.length(ext))
    numbers = taken.select(
        F.concat(F.regexp_extract(stem, r"(?s)^(.*)_([1-9][0-9]{0,8})$", 1), ext).alias("target_path"),
        F.regexp_extract(stem, r"_([1-9][0-9]{0,8})$", 1).alias("_number"),
    ).where("_number <> ''").withColumn("_number", F.col("_number").cast("long"))
    if on_disk is not None:
        numbers = numbers.unionByName(on_disk.select(path.alias("target_path"), F.lit(0).cast("long").alias("_number")))
    return numbers.distinct()


def _skips(numbers: DataFrame, actions: DataFrame) -> DataFrame:
    """``_path, _bucket, _from, _to, _skipped``: claimants ``_from`` to ``_to`` of a name leave out ``_skipped`` taken numbers.

    The i-th taken number t has t - i + 1 free ones below it, so the claimants after that
    many, up to those below the next taken number, leave out i.  Numbers are ranked per
    range and an interval is repeated for each bucket of claimants it meets: no name is
    gathered.  A number has at most nine digits, so a name has a bounded number of ranges.
    """
    ranged = numbers.withColumn("_range", F.floor(F.col("_number") / NUMBERS_A_RANGE))
    counts = ranged.groupBy("target_path", "_range").agg(F.count("*").alias("_in_range"), F.min("_number").alias("_low"))
    claims = actions.groupBy("target_path").agg(F.count("*").alias("_claims"))
    by_range = Window.partitionBy("target_path").orderBy("_range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        counts.join(claims, "target_path")
        .withColumn("_start", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
        .withColumn("_next_range", F.lead(F.col("_low") - F.col("_start")).over(by_range))
        .drop("_in_range", "_low")
    )
    within = Window.partitionBy("target_path", "_range").orderBy("_number")
    ranked = (
        ranged.join(ranges, ["target_path", "_range"])
        .withColumn("_skipped", F.col("_start") + F.row_number().over(within))
        .withColumn("_free", F.col("_number") - F.col("_skipped") + 1)
        .withColumn("_next", F.coalesce(F.lead("_free").over(within), "_next_range", "_claims"))
    )
    spans = ranked.select(
        F.col("target_path").alias("_path"), (F.col("_free") + 1).alias("_from"), F.least("_next", "_claims").alias("_to"), "_skipped"
    ).where("_from <= _to")
    bucket = lambda c: F.floor(F.col(c) / TURNS_A_BUCKET)
    return spans.withColumn("_bucket", F.explode(F.sequence(bucket("_from"), bucket("_to"))))


def resolve_names(
    actions: DataFrame,
    inventory: DataFrame | None = None,
    row_id: str = "action_id",
    floor: int = HOT_ROWS_MIN,
) -> DataFrame:
    """Give every action its own free target in ``resolved_path``.

    The first claimant keeps a free target; each later one (all of them when the target
    already exists) takes the next number whose name is neither on disk nor asked for by
    another action: the k-th claimant gets the k-th free number.  Numbered names of
    different targets never meet, because a name that is also a target counts as taken.
    """
    taken = actions.select(F.col("target_path").alias("resolved_path"))
    on_disk = None
    if inventory is not None:
        on_disk = inventory.select(F.col("path").alias("resolved_path"))
        taken = taken.unionByName(on_disk)
    numbered = number_rows(actions, ["target_path"], row_id, "_n", floor)
    kept = [c for c in numbered.columns if c != "_n"]
    met = numbered.withColumn("_turns", F.floor(F.col("_n") / TURNS_A_BUCKET)).join(
        _skips(_taken_numbers(taken, on_disk), actions),
        (F.col("target_path") == F.col("_path")) & (F.col("_turns") == F.col("_bucket")) & F.col("_n").between(F.col("_from"), F.col("_to")),
        "left",
    )
    number = F.col("_n") - 1 + F.coalesce("_skipped", F.lit(0))
    named = F.when(number > 0, suffixed(F.col("target_path"), number)).otherwise(F.col("target_path"))
    return met.select(*[c for c in kept if c != "resolved_path"], named.alias("resolved_path"))


def apply_conflict_policy(actions: DataFrame, strategy: str, floor: int = HOT_ROWS_MIN) -> DataFrame:
    """Claimants of one target under a policy.

    ``skip`` keeps the first claimant unless the target exists, ``replace`` lets the
    last one win, ``newest`` and ``largest`` keep one by time or size, ``rename``
    numbers them, ``ask`` leaves conflicts unresolved.
    """
    if strategy == "rename":
        return resolve_names(actions, floor=floor).withColumn("resolution_strategy", F.lit("rename"))
    if strategy == "ask":
        return actions.withColumn("resolved_path", F.col("target_path"))
    order = {
        "skip": F.struct(F.col("action_id")),
        "replace": F.struct(F.col("action_id")),
        "newest": F.struct(F.col("modified_at"), F.col("action_id")) if "modified_at" in actions.columns else None,
        "largest": F.struct(F.col("file_size"), F.col("action_id")),
    }[strategy]
    if order is None:
        raise ValueError("the policy 'newest' needs a column modified_at")
    pick = F.min_by if strategy == "skip" else F.max_by
    # map-side combined: one surviving row per target, never a whole group in one task
    winners = actions.groupBy("target_path").agg(pick(F.struct(*[c for c in actions.columns if c != "target_path"]), order).alias("w"))
    kept = winners.select("target_path", "w.*")
    if strategy == "skip":
        kept = kept.where(F.col("conflict_type").isNull())
    return kept.withColumn("resolution_strategy", F.lit(strategy)).withColumn("resolved_path", F.col("target_path"))


def outcome(actions: DataFrame, inventory: DataFrame, floor: int = HOT_ROWS_MIN) -> DataFrame:
    """What executing the plan would do: succeed, fail (source absent) or rename."""
    present = inventory.select(F.col("path").alias("source_path")).distinct().withColumn("_there", F.lit(True))
    named = resolve_names(actions, inventory, floor=floor)
    return named.join(present, "source_path", "left").withColumn(
        "outcome",
        F.when(F.col("_there").isNull(), "failed")
        .when(F.col("resolved_path") != F.col("target_path"), "renamed")
        .otherwise("moved"),
    ).drop("_there")


def rollback_list(outcomes: DataFrame) -> DataFrame:
    """Reverse moves of what succeeded; undo in descending ``step`` order.

    ``step`` must be the execution order recorded per action.
    """
    return outcomes.where(F.col("outcome") != "failed").select(
        (-F.col("step")).alias("undo_order"),
        F.col("resolved_path").alias("source_path"),
        F.col("source_path").alias("target_path"),
    )
