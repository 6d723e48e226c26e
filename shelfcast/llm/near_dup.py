"""MinHash near-duplicates by a signature-coordinate inverted join (operator 10).

Every text becomes a set of word shingles and a MinHash signature. Texts of
equal sets are one class from the start; one representative per class goes on.
Representatives are posted under each (coordinate, value) pair of their
signature. Two signatures that agree in at least ``matches`` coordinates must
meet under one of each side's rarest pairs (prefix principle), so only the
``shared - matches + 1`` rarest of a representative's shared pairs are kept,
and one that shares fewer than ``matches`` pairs with anybody leaves at once.

Postings are merged without writing out all pairs of a list. First every
member is paired with the list's hub, the member whose pairs are the most
common (the origin of a group of copies); candidates that agree in enough
coordinates are compared on their full shingle sets, and links are joined to
components. Then only what can still join two components is paired: members of
lists that hold several components. Each of them has a centre, the hub of most
followers among those it is at least ``CENTRE`` percent similar to, if any.

* Members of one centre are compared by their residuals, what their sets and
  the centre's don't share: the difference of two sets is that of their
  residuals, so a pair can link only if these overlap enough. An element of a
  residual that no other member has counts against its owner with any partner;
  that leaves nothing of a group whose members were changed in places of their
  own, however large it is. The rest meets under the rarest residual elements
  (prefix principle), where members of a list's main component never meet each
  other.
* Other pairs meet under the rarest shingles of their full sets, where groups
  of one centre, and members of one component, never meet each other.

What meets must agree in enough coordinates and is confirmed on full sets. A
pair that is skipped lies within one component already or can't be a link, so
no link between components is lost. ``matches`` is the largest number that two
sets at the similarity itself miss with a probability of at most ``miss`` (26
of 48 for 85 %, 1e-7).

The unit is the set: rows of equal sets are one node, whatever their doc_id.
Different texts under one doc_id are one document: their nodes are linked.

Defined cases: texts without words (null, empty, blank) have no shingle and
link with nothing; texts of fewer words than a shingle have one; a null doc_id
takes no part, is its own class (component null) and is kept; repeated rows
have one class, and each row is kept or not by its doc_id; extra columns are
not read; an empty table gives an empty table; long texts are hashed in slices.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from .common import Shared, map_rows, may_contain

MASK = (1 << 64) - 1
SLICE = 1 << 16
#: Parts of a list's members, which meet others in tasks of their own.
PARTS = 8
#: Least similarity, in percent, of a member and its centre. It decides how pairs are searched, not which are found.
CENTRE = 33
#: Rounds in which members that fit no other member of their list leave it.
ROUNDS = 2

SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.list_(pa.int64()))])
OPEN = pa.schema([("rep", pa.int64()), ("component", pa.int64()), ("centre", pa.int64()), ("shingles", pa.list_(pa.int64())), ("residual", pa.list_(pa.int64()))])
COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("union", pa.int64())])


def _spread(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers or offsets, from a fixed rule (splitmix64)."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & MASK
        z = x
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
        out.append((z ^ z >> 31) | 1)
    return np.array(out, np.uint64)


def matches_for(percent: int, coordinates: int, miss: float) -> int:
    """Largest m with P(fewer than m of the coordinates agree) <= miss at the similarity; 1 at least."""
    p, total, m = percent / 100, 0.0, 0
    while m < coordinates:
        total += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if total > miss:
            break
        m += 1
    return max(1, m)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; one of the whole text if it has fewer words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    p = np.uint64(0x9E3779B97F4A7C15)
    total = h[:n].copy()
    for k in range(1, min(width, len(h))):
        total = total * p + h[k:n + k]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def signature(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Least value of each coordinate's hash; coordinate and value together as one long."""
    least = np.full(len(scale), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), SLICE):
        part = shingles[at:at + SLICE]
        least = np.minimum(least, (part[None, :] * scale[:, None] + shift[:, None] >> np.uint64(32)).min(1))
    return (np.arange(len(scale), dtype=np.int64) << 32) + least.astype(np.int64)


def sign_documents(docs: DataFrame, coordinates: int, width: int) -> DataFrame:
    def rows(source):
        import xxhash

        scale, shift = _spread(coordinates, 1), _spread(coordinates, 2)
        for doc_id, h, text in source:
            found = shingle_set(text, width)
            if len(found):
                yield doc_id, h, len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found, scale, shift).tolist()
            else:
                yield doc_id, h, 0, None, None
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), rows, SIGNED)


def prefix_postings(reps: DataFrame, matches: int) -> DataFrame:
    """(key, rep, n_shingles, weight): each representative under its rarest shared pairs."""
    posted = reps.select("rep", F.explode("signature").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    kept = (posted.join(shared, "key").groupBy("rep")
            .agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("pairs"), F.sum("f").alias("weight"))  # one per coordinate at most
            .where(F.size("pairs") >= matches))
    rarest = F.slice("pairs", 1, F.size("pairs") - (matches - 1))
    return kept.select("rep", "weight", F.explode(rarest).alias("p")).select("p.key", "rep", "weight")


def _at_least(a: Column, b: Column, percent: int) -> Column:
    """A similarity of ``percent`` is possible for sets of these sizes."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): every member of a list with its hub b, the heaviest member (the smallest of equal ones)."""
    first = F.struct("weight", (-F.col("rep")).alias("minus"), "n_shingles")
    hubs = (postings.groupBy("key").agg(F.max(first).alias("hub"), F.count("*").alias("m")).where(F.col("m") > 1)
            .select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.n_shingles").alias("hub_n")))
    met = postings.join(hubs, "key").where((F.col("rep") != F.col("hub")) & _at_least(F.col("n_shingles"), F.col("hub_n"), percent))
    return met.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def centres_of(compared: DataFrame, percent: int = CENTRE) -> DataFrame:
    """(rep, centre): of the hubs it is similar to, itself included if it is one, the one of most followers.

    ``compared``: (a, b, common, union) of members a and hubs b.
    """
    near = compared.where(100 * F.col("common") >= percent * F.col("union")).select(F.col("a").alias("rep"), F.col("b").alias("hub"))
    near = near.unionAll(near.select(F.col("hub").alias("rep"), "hub").distinct())
    followers = near.groupBy("hub").agg(F.count("*").alias("m"))
    best = salted_join(near, followers, ["hub"]).groupBy("rep").agg(F.max(F.struct("m", (-F.col("hub")).alias("minus"))).alias("best"))
    return best.select("rep", (-F.col("best.minus")).alias("centre"))


def open_members(postings: DataFrame, components: DataFrame) -> DataFrame:
    """(rep, component) of the members of lists that still hold more than one component."""
    placed = (postings.select("key", "rep").join(components, "rep", "left")
              .select("key", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = (placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where(F.col("low") < F.col("high")).select("key"))
    return placed.join(mixed, "key").select("rep", "component").distinct()


def open_sets(members: DataFrame, texts: DataFrame, centres: DataFrame, width: int) -> DataFrame:
    """(rep, component, centre, shingles, residual) of members (rep, component); the last is null without a centre."""
    placed = texts.join(members, "rep").join(centres, "rep", "left")
    both = (placed.join(texts.select(F.col("rep").alias("centre"), F.col("text").alias("centre_text")), "centre", "left")
            .select("rep", "component", "centre", "text", "centre_text"))

    def rows(source):
        last = None, None
        for rep, component, centre, text, centre_text in source:
            found = shingle_set(text, width)
            if centre is None:
                yield rep, component, None, found.astype(np.int64).tolist(), None
                continue
            if last[0] != centre:
                last = centre, shingle_set(centre_text, width)
            residual = np.setxor1d(found, last[1], assume_unique=True)
            yield rep, component, centre, found.astype(np.int64).tolist(), residual.astype(np.int64).tolist()
    return map_rows(both, rows, OPEN, slice_rows=32)


def fitting(lists: DataFrame) -> DataFrame:
    """Members that fit some member of their list (centre, x), of lists that still hold several components."""
    best = (lists.groupBy("centre", "x")
            .agg(F.max("near").alias("most_near"), F.max("wide").alias("most_wide"), F.min("component").alias("low"), F.max("component").alias("high"))
            .where(F.col("low") < F.col("high")))
    return (lists.join(best, ["centre", "x"])
            .where((F.col("near") + F.col("most_wide") >= 0) & (F.col("wide") + F.col("most_near") >= 0)).select(lists.columns))


def residual_lists(sets: DataFrame, percent: int, store: Shared) -> DataFrame:
    """(centre, x, rep, component, near, wide, left): members under their rarest residual elements.

    With p the similarity, two sets link if the difference of their residuals
    is at most (100 - p) / (100 + p) of their sizes' sum. For a member, in units
    of 1 / (100 + p): ``near`` is its share of that bound less its residual,
    ``wide`` its share plus its shared elements less those of its own. A pair
    can link only if near + wide of the other reach 0 both ways, and if twice
    the elements ``left`` from their first common one on reach -(near + near).
    """
    share, whole = 100 - percent, 100 + percent
    known = sets.where(F.col("centre").isNotNull() & (F.size("residual") > 0))
    sizes = known.select("rep", "component", "centre", F.size("shingles").alias("n"), F.size("residual").alias("r"))
    spread = known.select("rep", "centre", F.explode("residual").alias("x"))
    shared = spread.groupBy("centre", "x").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    # elements of one member alone come before all shared ones
    ordered = (spread.join(shared, ["centre", "x"]).groupBy("rep")
               .agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("s")).join(sizes, "rep"))
    m = F.size("s")
    ordered = ordered.withColumns({
        "near": (share * F.col("n") - whole * F.col("r")).cast("long"),
        "wide": (share * F.col("n") + whole * (2 * m - F.col("r"))).cast("long"),
        # a partner shares all but (100 - p) / p of the set's size of the residual, and one element at least
        "first": F.least(m, F.expr(f"cast({share} * n div {percent} AS INT)") + 1 - (F.col("r") - m))})
    lists = (ordered.where(F.col("first") > 0)
             .select("rep", "component", "centre", "near", "wide", m.alias("m"), F.posexplode(F.slice("s", 1, F.col("first"))).alias("k", "e"))
             .select("centre", F.col("e.x").alias("x"), "rep", "component", "near", "wide", (F.col("m") - F.col("k")).alias("left")))
    lists = store.write(lists, "residual-0")
    for i in range(ROUNDS):
        lists = store.write(fitting(lists), f"residual-{i + 1}")
        store.drop(f"residual-{i}")
    return lists


def within_centres(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``residual_lists`` that can link, in different components.

    Members of a list's main component meet only those outside it.
    """
    per_component = lists.groupBy("centre", "x", "component").agg(F.count("*").alias("m"))
    main = per_component.groupBy("centre", "x").agg(F.max(F.struct("m", "component"))["component"].alias("main"))
    placed = lists.join(main, ["centre", "x"]).withColumn("inside", F.col("component") == F.col("main")).drop("main")
    part = F.pmod(F.xxhash64("rep"), F.lit(PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    outside = placed.where(~F.col("inside")).withColumn("part", every)
    other = placed.select("centre", "x", part.alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("rep", "component", "near", "wide", "left", "inside")])
    met = (outside.join(other, ["centre", "x", "part"])
           .where((F.col("component") != F.col("component_b")) & (F.col("inside_b") | (F.col("rep") < F.col("rep_b")))
                  & (F.col("near") + F.col("wide_b") >= 0) & (F.col("near_b") + F.col("wide") >= 0)
                  & (2 * (100 + percent) * F.least("left", "left_b") + F.col("near") + F.col("near_b") >= 0)))
    return met.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def meetings(first: DataFrame) -> DataFrame:
    """(shingle, block, part, block_b, part_b): parts of different blocks under one shingle, each pair once.

    A block has at most ``PARTS`` parts, so its members never meet each other, however many there are.
    """
    parts = first.select("shingle", "block", "part").distinct()
    other = parts.select("shingle", F.col("block").alias("block_b"), F.col("part").alias("part_b"))
    return parts.join(other, "shingle").where(F.col("block") < F.col("block_b"))


def between_centres(sets: DataFrame, percent: int, store: Shared | None = None) -> DataFrame:
    """(a, b): members of different components, not of one centre, that can reach the similarity.

    Shingles are ordered by how many sets hold them, the rarest first. Sets
    that reach the similarity share one of the first ``n - ceil(percent n) + 1``
    of each, and at the first one they share, what is left of either set still
    suffices; other pairs of a list are skipped unseen. A block is all members
    of one centre, or of one component where they have none; only lists that
    hold several blocks are paired, by parts of different blocks.
    """
    # centres and components are numbered alike: from 0 up and from -1 down
    block = F.coalesce("centre", -1 - F.col("component"))
    sizes = sets.select("rep", "component", block.alias("block"), F.size("shingles").alias("n"))
    spread = sets.select("rep", F.explode("shingles").alias("shingle"))
    shared = spread.groupBy("shingle").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    # a shingle that no other set holds comes before all shared ones
    ordered = (spread.join(shared, "shingle").groupBy("rep")
               .agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("s")).join(sizes, "rep"))
    needed = F.expr(f"({percent} * n + 99) div 100").cast("int")
    first = (ordered.where(F.size("s") >= needed)
             .select("rep", "component", "block", "n", F.size("s").alias("m"), F.posexplode(F.slice("s", 1, F.size("s") - needed + 1)).alias("k", "x"))
             .select(F.col("x.shingle").alias("shingle"), "rep", "component", "block", "n", (F.col("m") - F.col("k")).alias("left")))
    store = store or Shared(sets.sparkSession, "bridging")
    first = store.write(first.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS))), "bridging-first")
    mixed = (first.groupBy("shingle").agg(*[f(c).alias(f"{n}_{c}") for c in ("component", "block") for n, f in (("low", F.min), ("high", F.max))])
             .where((F.col("low_component") < F.col("high_component")) & (F.col("low_block") < F.col("high_block"))).select("shingle"))
    first = store.write(first.join(mixed, "shingle"), "bridging-mixed")
    other = first.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("block", "part", "rep", "component", "n", "left")])
    most = F.least("left", "left_b")
    met = (first.join(meetings(first), ["shingle", "block", "part"]).join(other, ["shingle", "block_b", "part_b"])
           .where((F.col("component") != F.col("component_b")) & (100 * most >= percent * (F.col("n") + F.col("n_b") - most))))
    return met.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def agreeing(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``matches`` coordinates."""
    both = (pairs.join(reps.select(F.col("rep").alias("a"), F.col("signature").alias("s_a")), "a")
            .join(reps.select(F.col("rep").alias("b"), F.col("signature").alias("s_b")), "b"))
    return both.where(F.size(F.array_intersect("s_a", "s_b")) >= matches).select("a", "b")


def compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, common, union): pairs with the counts of their full shingle sets; ``texts``: rep, text."""
    both = (pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("t_a")), "a")
            .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("t_b")), "b"))

    def rows(source):
        last: dict[int, np.ndarray] = {}
        for a, b, t_a, t_b in source:
            last = {x: last[x] if x in last else shingle_set(t, width) for x, t in ((a, t_a), (b, t_b))}
            common = len(np.intersect1d(last[a], last[b], assume_unique=True))
            yield a, b, common, len(last[a]) + len(last[b]) - common
    return map_rows(both.select("a", "b", "t_a", "t_b"), rows, COMPARED, slice_rows=32)


def links_of(counted: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that reach the similarity."""
    return counted.where(100 * F.col("common") >= percent * F.col("union")).select("a", "b")


def components_of(links: DataFrame, store: Shared, name: str) -> DataFrame:
    """(rep, component) of every linked representative; component: the smallest reachable one.

    Rounds of the least neighbour's label, then that label's own label, each
    written to the shared folder, until nothing changes.
    """
    edges = store.write(links.select(F.col("a").alias("rep"), F.col("b").alias("other"))
                        .unionAll(links.select("b", "a")), f"{name}-edges")
    labels = store.write(edges.groupBy("rep").agg(F.min("other").alias("o"))
                         .select("rep", F.least("rep", "o").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (edges.join(labels.select(F.col("rep").alias("other"), F.col("component").alias("c")), "other")
                .groupBy("rep").agg(F.min("c").alias("c")))
        least = labels.join(near, "rep").select("rep", "component", F.least("component", "c").alias("c"))
        jump = labels.select(F.col("rep").alias("c"), F.col("component").alias("c2"))
        new = store.write(least.join(jump, "c").select(
            "rep", F.least("c", "c2").alias("component"), (F.least("c", "c2") < F.col("component")).alias("moved")), f"{name}-{step}")
        moved = new.where("moved").limit(1).count()
        store.drop(f"{name}-{step - 1}")
        labels = new.select("rep", "component")
        if not moved:
            store.drop(f"{name}-edges")
            return labels


def links_of_documents(known: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): nodes of the different texts under one doc_id, each with the one of the least set."""
    several = (known.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
               .where(F.col("low") < F.col("high")).select("doc_id", "low"))
    pairs = salted_join(known.select("doc_id", "set_id"), several, ["doc_id"]).where(F.col("set_id") != F.col("low")).select("set_id", "low").distinct()
    nodes = reps.select("set_id", "rep")
    return (salted_join(pairs.join(nodes.withColumnRenamed("rep", "a"), "set_id"),
                        nodes.select(F.col("set_id").alias("low"), F.col("rep").alias("b")), ["low"]).select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, coordinates: int = 48, miss: float = 1e-7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    matches = matches_for(percent, coordinates, miss)
    store = Shared(docs.sparkSession, "near-dup")
    signed = store.write(sign_documents(docs, coordinates, width), "signed")
    known = signed.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    # equal sets have equal signatures; a node is a set, numbered once, with the text of its smallest doc_id
    reps = store.write(known.groupBy("set_id").agg(F.min(F.struct("doc_id", "h")).alias("of"), F.first("n_shingles").alias("n_shingles"),
                                                   F.first("signature").alias("signature"))
                       .select(F.monotonically_increasing_id().alias("rep"), "set_id", "of.doc_id", "of.h", "n_shingles", "signature"), "reps")
    postings = store.write(prefix_postings(reps, matches).join(reps.select("rep", "n_shingles"), "rep"), "postings")
    store.free()
    posted = reps.select("rep", "doc_id", "h").join(postings.select("rep").distinct(), "rep")
    wanted = docs.where(F.col("doc_id").isNotNull() & may_contain(posted, "doc_id", docs["doc_id"]))
    texts = store.write(wanted.select("doc_id", F.xxhash64("text").alias("h"), "text").join(posted, ["doc_id", "h"])
                        .select("rep", "text").dropDuplicates(["rep"]), "texts")
    # pairs at the similarity of a centre, by the share of coordinates; those at the similarity itself are among them
    first_pairs = store.write(agreeing(hub_pairs(postings, min(CENTRE, percent)), reps, min(matches, CENTRE * coordinates // 100)), "hub-pairs")
    counted = store.write(compared(first_pairs, texts, width), "hub-counts")
    links = store.write(links_of(counted, percent).unionAll(links_of_documents(known, reps)), "hub-links")
    joined = components_of(links, store, "hub-components")
    store.free()
    left = store.write(open_sets(open_members(postings, joined), texts, centres_of(counted), width), "open-sets")
    rest = within_centres(residual_lists(left, percent, store), percent).unionAll(between_centres(left, percent, store))
    more = store.write(links_of(compared(agreeing(rest, reps, matches), texts, width), percent), "bridging-links")
    if more.limit(1).count():
        joined = components_of(links.unionAll(more), store, "components")
    # a component is named by its smallest doc_id
    named = reps.select("rep", "set_id", "doc_id").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = store.write(salted_join(named, named.groupBy("component").agg(F.min("doc_id").alias("component_id")), ["component"])
                          .select("set_id", "component_id"), "classes")
    found = store.write(signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
                        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "found")
    store.drop(*[t for t in store.tables() if t != "found"])
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, coordinates: int = 48, miss: float = 1e-7) -> DataFrame:
    """One document per near-duplicate group, that of the smallest doc_id, with all columns.

    Only ids of dropped documents are joined back, so a document without a
    near-duplicate is never lost. Of rows that repeat a kept doc_id all stay.
    """
    dropped = (near_duplicates(docs, percent, width, coordinates, miss)
               .where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct())
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
