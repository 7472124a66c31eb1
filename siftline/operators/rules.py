"""The rule filter: ordered rule groups give drop and review reasons and typed signals; a status follows."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import dates as D, dictionary as W, places as P, text as T, vocabulary as V


@dataclass(frozen=True)
class Profile:
    """What a reader looks for: term lists, languages, places, limits."""

    title_terms: tuple[str, ...] = ()
    exclude_title_terms: tuple[str, ...] = ()
    drop_always_terms: tuple[str, ...] = ()
    keep_level_terms: tuple[str, ...] = ()
    drop_level_terms: tuple[str, ...] = ()
    drop_label_terms: tuple[str, ...] = ()
    max_years_keep: int = 2
    max_years_review: int = 3
    languages_ok: tuple[str, ...] = ("en",)
    languages_weak: tuple[str, ...] = ()
    drop_if_written_in: tuple[str, ...] = ()
    tiers: tuple[tuple[str, ...], ...] = ((), (), ())
    notes: dict[str, str] = field(default_factory=dict)
    max_age_days: int = 60


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def country_tier(country: Column, profile: Profile) -> Column:
    out = F.when(F.lit(False), 0)
    for n, codes in enumerate(profile.tiers, 1):
        out = out.when(country.isin(list(codes) or [""]), n)
    return out


def evaluate(jobs: DataFrame, profile: Profile, today: date, requirements: DataFrame | None = None, liveness: DataFrame | None = None) -> DataFrame:
    """id, status, reasons, signals, location_tier for postings with title, description, seniority_raw, posting_language,
    country, remote, remote_region, location_raw, posted_at. requirements: id, required, optional, evidence; liveness: id, status, reason, day."""
    df = jobs
    for name, other, columns in (("requirements", requirements, ("required", "optional", "evidence")), ("liveness", liveness, ("live_status", "live_reason", "live_day"))):
        if other is not None:
            df = df.join(other.select("id", *columns), "id", "left")
    empty = F.array().cast("array<string>")
    title = F.coalesce("title", F.lit(""))
    text = F.concat_ws("\n", "title", "description")
    dead = F.lit(None).cast("string")
    if liveness is not None:
        dead = F.when(F.col("live_status") == "closed", F.format_string("posting closed (checked %s)", "live_day")).when(F.col("live_status") == "gone", F.format_string("posting gone (%s, checked %s)", "live_reason", "live_day"))
    keep, out, always = (T.any_term(x) for x in (profile.title_terms, profile.exclude_title_terms, profile.drop_always_terms))
    kept_title = T.found(title, keep)
    described = T.found(F.substring("description", 1, 600), keep)
    off = F.lit(keep is not None) & ~kept_title
    role = (
        F.when(T.found(title, always), F.concat(F.lit("title excluded by profile regardless of role/level: "), _quoted(title)))
        .when(T.found(title, out) & ~kept_title, F.concat(F.lit("title looks like a non-software role: "), _quoted(title)))
        .when(off & ~described, F.concat(F.lit("title not a software/IT role: "), _quoted(title)))
    )
    role_review = F.when(~T.found(title, always) & ~(T.found(title, out) & ~kept_title) & off & described, "title not obviously software, description mentions it")
    keep_level, drop_level, drop_label = (T.any_term(x) for x in (profile.keep_level_terms, profile.drop_level_terms, profile.drop_label_terms))
    label = F.coalesce("seniority_raw", F.lit(""))
    bad_label = (label != "") & ~T.found(label, keep_level) & (T.found(label, drop_level) | T.found(label, drop_label))
    seniority = F.when(T.found(title, keep_level), "kept_by_title").when(T.found(title, drop_level), "excluded_by_title").when(bad_label, "excluded_by_label").otherwise("unlabeled")
    df = df.withColumn("_years", D.years_required(text)).withColumn("_deadline", D.find_deadline(text, today))
    df = df.withColumn("_seniority", seniority).withColumn("_region0", P.remote_region(F.concat_ws(" ", "remote_region", "location_raw")))
    df = df.withColumn("_region", F.when((F.col("_region0") == "unknown") & (F.col("remote") == "remote"), F.coalesce(P.remote_region(F.col("description")), F.lit("unknown"))).otherwise(F.col("_region0")))
    level = F.when(F.col("_seniority") == "excluded_by_title", F.concat(F.lit("title level excluded by profile: "), _quoted(title))).when(F.col("_seniority") == "excluded_by_label", F.concat(F.lit("seniority label "), _quoted(label), F.lit(" excluded by profile")))
    years, kept_level = F.col("_years"), F.col("_seniority") == "kept_by_title"
    many = F.when((years > profile.max_years_review) & ~kept_level, F.format_string("asks for %d+ years of experience", years))
    many_review = F.when((years > profile.max_years_review) & kept_level, F.format_string("title matches the profile level terms but mentions %d years", years)).when((years > profile.max_years_keep) & (years <= profile.max_years_review), F.format_string("asks for %d years of experience", years))
    lang = F.col("posting_language")
    written = F.when(lang.isin(list(profile.drop_if_written_in) or [""]), F.concat(F.lit("posting written in "), lang))
    written_review = F.when(written.isNull() & lang.isin(list(profile.languages_weak) or [""]), F.concat(F.lit("posting written in "), lang))
    if requirements is not None:
        needed = F.filter(F.array_sort(F.coalesce("required", empty)), lambda c: ~c.isin(list(profile.languages_ok)))
        said = lambda c: F.concat(F.lit("requires "), c, F.lit(": "), _quoted(F.coalesce(F.element_at("evidence", c), F.lit(""))))
        weak = list(profile.languages_weak) or [""]
        need_drop = F.transform(F.filter(needed, lambda c: ~c.isin(weak)), said)
        need_review = F.transform(F.filter(needed, lambda c: c.isin(weak)), said)
    else:
        need_drop = need_review = empty
    remote = F.col("remote") == "remote"
    tier = F.when(remote, F.coalesce(country_tier(F.col("country"), profile), F.lit(0))).otherwise(country_tier(F.col("country"), profile))
    only = F.when(F.startswith("_region", F.lit("country_only:")), F.substring("_region", 14, 9))
    place = F.when(~remote & tier.isNull() & (F.coalesce("country", F.lit("")) != ""), F.format_string("on-site in %s, outside target countries", "country"))
    place_review = (
        F.when(remote & (F.col("_region") == "us_only"), "remote but text suggests US-only; worth checking (high pay)")
        .when(remote & only.isNotNull() & country_tier(only, profile).isNull(), F.format_string("remote but restricted to %s, outside target countries", only))
        .when(~remote & tier.isNull() & (F.coalesce("country", F.lit("")) == "") & (F.col("remote") == "unknown"), "location unknown")
        .when(~remote & tier.isNull() & (F.coalesce("country", F.lit("")) == ""), "on-site with unknown country")
    )
    age = F.date_diff(F.lit(today), F.to_date("posted_at"))
    old = F.when(age > profile.max_age_days, F.format_string(f"posting is %d days old (max {profile.max_age_days})", age))
    passed = F.when(F.col("_deadline") < F.lit(today), F.concat(F.lit("application deadline passed on "), F.col("_deadline").cast("string")))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    drops = F.concat(some(dead, role, level, many, written), need_drop, some(place, old, passed))
    reviews = F.concat(some(role_review, many_review, written_review), need_review, some(place_review))
    signals = F.struct(
        F.col("_seniority").alias("seniority"), years.alias("years_required"), lang.alias("posting_language"), F.col("remote").alias("remote"), F.col("_region").alias("remote_region"),
        age.alias("age_days"), F.col("_deadline").alias("deadline"), F.when(F.col("_deadline") >= F.lit(today), F.date_diff("_deadline", F.lit(today))).alias("closes_in_days"), T.evergreen(title, text).alias("evergreen"),
        F.when(tier == 3, F.element_at(F.create_map(*[F.lit(x) for kv in (profile.notes or {"": ""}).items() for x in kv]), F.coalesce("country", F.lit("-")))).alias("work_rights_note"),
    )
    status = F.when(F.size("_drops") > 0, "drop").when(F.size("_reviews") > 0, "review").otherwise("keep")
    df = df.withColumn("_drops", drops).withColumn("_reviews", reviews)
    return df.select("id", status.alias("status"), F.concat("_drops", "_reviews").alias("reasons"), signals.alias("signals"), tier.alias("location_tier"))


def stale_only(reasons: Column) -> Column:
    """At least one reason, and all of them about age, deadline or a closed page."""
    return (F.size(reasons) > 0) & F.forall(reasons, lambda r: T.reason_category(r).isin(*V.STALE_CATEGORIES))


def drop_counts(results: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent drop reasons, named by what stands before the colon."""
    r = results.filter("status = 'drop'").select(F.explode("reasons").alias("reason"))
    return r.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).count().orderBy(F.desc("count"), "reason").limit(n)


def language_requirements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, required, optional (sorted codes), evidence (code to sentence), by sentence and clause.

    A clause decides for the languages it names; one without keywords takes its sentence's verdict; a negated one
    makes them optional. What one sentence requires stays required.
    """
    names = [n for x in V.LANGUAGE_NAMES.values() for n in x]
    every = W.tree_pattern(names)
    clause = r"(?iuU)\s*[;,()/]\s*|\s+[-–—]\s+|\s+(?:and|und|ja|och|og|e|y|et)\s+(?=(?:" + every + "))"
    low = F.lower(F.col(text))
    docs = docs.filter(low.rlike(W.mentions(names, W.PLAIN_START)) | T.folds_oddly(low))  # most texts name no language: they are read once, plainly
    s = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), V.SENTENCE_END)).alias("_p", "_s"))
    s = s.withColumn("_s", F.trim("_s")).filter((F.col("_s") != "") & (F.length("_s") <= V.LONGEST_SENTENCE)).withColumn("_low", F.lower("_s")).filter(F.col("_low").rlike(W.mentions(names)))
    s = s.withColumn("_sreq", F.col("_low").rlike(V.REQUIRED) & ~F.col("_low").rlike(V.OPTIONAL)).withColumn("_sneg", F.col("_low").rlike(V.NOT_NEEDED))
    c = s.select(key, "_p", "_s", "_sreq", "_sneg", F.explode(F.split("_low", clause)).alias("_c"))
    c = c.withColumn("_hits", W.codes_in(F.col("_c"), V.LANGUAGE_NAMES)).filter(F.size("_hits") > 0)
    req, opt, neg = (F.col("_c").rlike(p) for p in (V.REQUIRED, V.OPTIONAL, V.NOT_NEEDED))
    needs = F.when(neg | (~req & ~opt & F.col("_sneg")), False).when(req | opt, req & ~opt).otherwise(F.col("_sreq"))
    c = c.withColumn("_needs", needs).select(key, "_p", "_s", "_needs", F.explode("_hits").alias("code"))
    g = c.groupBy(key, "code").agg(F.max("_needs").alias("_needs"), F.min_by("_s", F.when(F.col("_needs"), F.col("_p"))).alias("_said"))
    pick = lambda need: F.array_sort(F.filter(F.collect_list(F.when(F.col("_needs") == need, F.col("code"))), lambda x: x.isNotNull()))
    said = F.map_from_entries(F.filter(F.collect_list(F.when(F.col("_needs"), F.struct("code", F.substring("_said", 1, 200).alias("s")))), lambda x: x.isNotNull()))
    return g.groupBy(key).agg(pick(True).alias("required"), pick(False).alias("optional"), said.alias("evidence"))

