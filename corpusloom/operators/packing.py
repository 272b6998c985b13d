"""Token sequences: fixed-length blocks, padding, label masks and fill-in-the-middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import unit_hash
from corpusloom.functions.tokens import Tokenizer, default_tokenizer
from corpusloom.operators.ordering import first_n, in_ranges, numbered_ranges, range_cuts
from corpusloom.session import materialize

# Fixed value: label of positions that do not count in the loss.
IGNORE_INDEX = -100
SHARD_ROWS = 1000


# The columns of a source row that its ids take the place of.
SOURCE_COLUMNS = (
    "repo_name", "path", "copies", "size", "content", "license",
    "hash", "line_mean", "line_max", "alpha_frac", "autogenerated",
)


def pretokenize(
    df: DataFrame,
    content: str = "content",
    tokenizer: Tokenizer = default_tokenizer,
    drop: tuple[str, ...] = SOURCE_COLUMNS,
) -> DataFrame:
    """``input_ids`` and ``ratio_char_token`` in place of the source columns."""
    ids = df.withColumns({"input_ids": tokenizer(F.col(content)), "_chars": F.length(content)})
    ratio = F.try_divide(F.col("_chars").cast("double"), F.size("input_ids"))
    return ids.withColumn("ratio_char_token", ratio).drop("_chars", content, *drop)


def _blocks(df: DataFrame, key: str, tokens: Column, count: Column, size: Column, limit: float, block: int) -> DataFrame:
    """(buffer, block, input_ids): rows in key order fill buffers by their ``size``; the tokens of a buffer are joined and cut.

    Keys are cut into ranges. Sizes alone, written once, tell what lies before each range and where the buffer that it
    begins in was opened: a row a range. With these every range is laid out for itself, so tokens are shuffled
    once, to their range, and only blocks that cross a border meet again.
    """
    sizes = materialize(df.select(F.col(key).alias("id"), size.cast("bigint").alias("size"), count.cast("bigint").alias("n")), "sizes")
    cuts = range_cuts(sizes, "id")
    ahead = Window.partitionBy("_bin").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)

    def placed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
        """Sizes and tokens before each row, and its buffer."""
        summed = rows.withColumns({c: F.coalesce(F.sum(v).over(ahead), F.lit(0)) for c, v in (("_size", "size"), ("_at", "n"))})
        # ``ranges`` has a row per range, whose number is bounded.
        moved = summed.join(F.broadcast(ranges), "_bin").withColumn("_at", F.col("_at") + F.col("_from"))
        return moved.withColumn("buffer", F.floor((F.col("_size") + F.col("_size_from")) / F.lit(limit)).cast("bigint"))

    binned = in_ranges(sizes, "id", cuts)
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy("_bin").agg(F.sum("size").alias("_size"), F.sum("n").alias("_n"))
    starts = totals.select(
        "_bin", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_size_from"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), "_n"
    )
    starts = materialize(starts.withColumn("_to", F.col("_from") + F.col("_n")).drop("_n"), "ranges")
    opened = placed(binned, starts).groupBy("buffer").agg(F.min("_at").alias("_carried"))
    first = starts.withColumn("buffer", F.floor(F.col("_size_from") / F.lit(limit)).cast("bigint"))
    ranges = materialize(opened.join(F.broadcast(first), "buffer").drop("buffer"), "ranges")

    rows = in_ranges(df.select(F.col(key).alias("id"), tokens.alias("tokens"), size.cast("bigint").alias("size"), count.cast("bigint").alias("n")), "id", cuts)
    inside = Window.partitionBy("_bin").orderBy("id")
    laid = placed(rows, ranges)
    opens = F.when(F.lag("buffer").over(inside) != F.col("buffer"), F.col("_at"))
    laid = laid.withColumn("_opens", opens)
    opened = F.coalesce(F.last("_opens", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    laid = laid.withColumn("_opened", opened).withColumn("_start", F.col("_at") - F.col("_opened"))

    def piece(b: Column) -> Column:
        head = F.greatest(b * block - F.col("_start"), F.lit(0))
        tail = F.least((b + 1) * block - F.col("_start"), F.size("tokens"))
        ids = F.slice("tokens", (head + 1).cast("int"), (tail - head).cast("int"))
        begin = F.col("_opened") + b * block
        whole = (begin >= F.col("_from")) & (begin + block <= F.col("_to"))
        return F.struct(b.alias("block"), whole.alias("whole"), F.struct((F.col("_start") + head).alias("at"), ids.alias("ids")).alias("piece"))

    # Cut inside the row, so an exploded row carries its slice and not the whole text: a row is exploded over the blocks it
    # touches, not over its tokens. A filter on the tokens would be pushed down and compute them twice; an empty row has no blocks.
    blocks = F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.size("tokens") - 1) / block))
    pieces = laid.select("_bin", "buffer", F.explode(F.transform(F.when(F.size("tokens") > 0, blocks), piece)).alias("p"))
    pieces = pieces.select("_bin", "buffer", "p.*")

    def put_together(pieces: DataFrame, *keys: str) -> DataFrame:
        """A group holds the slices of one block: at most ``block`` tokens, whatever the size of a text or buffer."""
        grouped = pieces.groupBy(*keys, "buffer", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        return grouped.select("buffer", "block", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("input_ids"))

    return put_together(pieces.where("whole"), "_bin").unionByName(put_together(pieces.where("NOT whole")))


def running_token_offset(df: DataFrame, shard: str, order: str, n_tokens: str, name: str = "start") -> DataFrame:
    """Tokens before each row inside its shard."""
    before = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(n_tokens).over(before), F.lit(0)).cast("bigint"))


def shard_of(key: str = "id", rows_per_shard: int = SHARD_ROWS) -> Column:
    """Consecutive ids share a shard: a bounded number of rows, since ids are unique."""
    return F.floor(F.col(key) / rows_per_shard).cast("bigint")


def pack_constant_length(
    df: DataFrame,
    separator: int | Column | None = 0,
    seq_length: int = 1024,
    num_of_sequences: int = 1024,
    chars_per_token: float = 3.6,
    tokenized: bool = False,
    key: str = "id",
    tokens: str = "input_ids",
    n_chars: str = "n_chars",
    n_tokens: str | None = None,
) -> DataFrame:
    """(buffer, block, input_ids): blocks of exactly ``seq_length`` tokens.

    Rows in key order fill buffers of ``seq_length * num_of_sequences`` tokens (or that many estimated from
    characters): a row belongs to the buffer in which the sizes before it end. The texts of a buffer, each
    followed by the separator, are joined and cut, and the buffer's remainder is dropped. Keys only give the
    order, so gaps between them, negative or hashed ones change nothing.

    ``tokens`` may be any array, such as structs of a token and its label, with a ``separator`` of the same kind, or
    none. The layout is found from running sums of the sizes alone; ``n_tokens`` names a column with the token count, if
    there is one, so that this pass neither reads nor computes tokens.
    """
    limit = seq_length * num_of_sequences * (1.0 if tokenized else chars_per_token)
    count = F.size(tokens) if n_tokens is None else F.col(n_tokens)
    stop = F.lit(separator) if isinstance(separator, int) else separator
    ended = F.col(tokens) if stop is None else F.concat(tokens, F.array(stop))
    blocks = _blocks(df, key, ended, count + int(stop is not None), count if tokenized else F.col(n_chars), limit, seq_length)
    return blocks.where(F.size("input_ids") == seq_length)


def pack_group_texts(
    df: DataFrame,
    block_size: int = 1024,
    key: str = "id",
    tokens: str = "input_ids",
    batch_rows: int = 1000,
    n_tokens: str | None = None,
) -> DataFrame:
    """(batch, block, input_ids) per batch of ``batch_rows`` rows, without separators.

    A batch shorter than one block is kept as a short block, otherwise the remainder is dropped.
    """
    count = F.size(tokens) if n_tokens is None else F.col(n_tokens)
    blocks = _blocks(df, key, F.col(tokens), count, F.lit(1), batch_rows, block_size)
    return blocks.where((F.size("input_ids") == block_size) | (F.col("block") == 0)).withColumnRenamed("buffer", "batch")


def chunk_overflow(df: DataFrame, block_size: int = 1024, tokens: str = "input_ids", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Full pieces of ``block_size`` tokens of each text by itself."""
    n = F.floor(F.size(tokens) / block_size).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    chunks = F.transform(places, lambda i: F.slice(tokens, i * block_size + 1, F.lit(block_size)))
    return df.select(*keep, F.posexplode(chunks).alias("chunk", "input_ids"))


def truncate_tokens(tokens: str | Column, max_length: int = 1024) -> Column:
    return F.slice(tokens, 1, max_length)


def pad_batch(df: DataFrame, batch: str = "batch", tokens: str = "input_ids", pad_id: int = 0) -> DataFrame:
    """Pad to the longest row of the batch; adds ``attention_mask`` and ``input_len``.

    Only the longest length per batch is aggregated; rows are not sorted or buffered.
    """
    longest = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("_longest"))
    missing = F.col("_longest") - F.size(tokens)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), missing))
    return (
        df.join(longest, batch)
        .withColumns({"input_len": F.size(tokens), "attention_mask": mask})
        .withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(pad_id), missing)))
        .drop("_longest")
    )


def mask_user_labels(tokens: str | Column, user_id: int, assistant_id: int, open_user: Column | None = None) -> Column:
    """Labels equal to the tokens, with -100 from each user token up to the next assistant token.

    ``open_user`` tells whether a block begins inside a user turn, as a block cut from a stream of
    dialogues may; without it a block begins outside one.
    """
    ids = F.col(tokens) if isinstance(tokens, str) else tokens
    begin = F.lit(False) if open_user is None else F.coalesce(open_user, F.lit(False))
    # The parts between role tokens, each with the role token in front of it.
    marks = F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: F.get(ids, i).isin(user_id, assistant_id))
    marks = F.when(F.size(ids) > 0, marks).otherwise(F.array().cast("array<int>"))

    def part(at: Column, k: Column) -> Column:
        until = F.coalesce(F.get(marks, k + 1), F.size(ids))
        piece = F.slice(ids, at + 1, until - at)
        ignored = F.array_repeat(F.lit(IGNORE_INDEX), until - at)
        return F.when(F.get(ids, at) == user_id, ignored).otherwise(piece)

    first = F.coalesce(F.get(marks, F.lit(0)), F.size(ids))
    head = F.when(begin, F.array_repeat(F.lit(IGNORE_INDEX), first)).otherwise(F.slice(ids, F.lit(1), first))
    return F.concat(head, F.flatten(F.transform(marks, part)))


def fim_permute(
    df: DataFrame,
    prefix_id: int | None,
    middle_id: int | None,
    suffix_id: int | None,
    pad_id: int | None = None,
    fim_rate: float = 0.5,
    fim_spm_rate: float = 0.5,
    truncate_or_pad: bool = False,
    seed: int = 0,
    key: str = "id",
    tokens: str = "input_ids",
) -> DataFrame:
    """Fill-in-the-middle: cut a share of the rows at two random places and reorder the pieces.

    All draws come from (seed, key), so a retried task repeats them. Without special ids
    the rows stay as they are.
    """
    if suffix_id is None or fim_rate <= 0:
        return df
    n = F.size(tokens)
    cut_a = F.floor(unit_hash(seed, key, "fim-a") * (n + 1)).cast("int")
    cut_b = F.floor(unit_hash(seed, key, "fim-b") * (n + 1)).cast("int")
    staged = df.withColumns({"_lo": F.least(cut_a, cut_b), "_hi": F.greatest(cut_a, cut_b)})
    prefix = F.slice(tokens, F.lit(1), F.col("_lo"))
    middle = F.slice(tokens, F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))
    suffix = F.slice(tokens, F.col("_hi") + 1, n - F.col("_hi"))
    permuted = unit_hash(seed, key, "fim") < fim_rate
    if truncate_or_pad:
        # The three special tokens always make the row longer, so the suffix gives way.
        extra = 3
        permuted = permuted & (n - F.col("_hi") > extra)
        suffix = F.slice(tokens, F.col("_hi") + 1, F.greatest(n - F.col("_hi") - extra, F.lit(0)))
    pre, mid, suf = (F.array(F.lit(i)) for i in (prefix_id, middle_id, suffix_id))
    spm = F.concat(pre, suf, suffix, mid, prefix, middle)
    psm = F.concat(pre, prefix, suf, suffix, mid, middle)
    new = F.when(unit_hash(seed, key, "fim-spm") < fim_spm_rate, spm).otherwise(psm)
    return staged.withColumn(tokens, F.when(permuted, new).otherwise(F.col(tokens))).drop("_lo", "_hi")


def label_encode(df: DataFrame, label: str = "label", name: str = "label_id") -> DataFrame:
    """Class names as numbers in alphabetical order.

    The distinct names are range-partitioned and numbered inside their ranges; the look-up join is left to
    the optimizer, which broadcasts the list when its measured size allows.
    """
    numbered = numbered_ranges(df.select(label).where(F.col(label).isNotNull()).distinct(), [label], name)
    return df.join(numbered, label)


def chars_per_token(
    df: DataFrame, key: str = "id", content: str = "content", n_tokens: Column | None = None, examples: int | None = None
) -> DataFrame:
    """Characters per token over all rows, or over the first ``examples`` by key."""
    from corpusloom.functions.tokens import token_count

    count = token_count(content) if n_tokens is None else n_tokens
    head = df if examples is None else first_n(df, key, examples)
    return head.agg(F.try_divide(F.sum(F.length(content)).cast("double"), F.sum(count)).alias("chars_per_token"))
