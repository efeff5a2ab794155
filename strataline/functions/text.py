"""Scalar text functions as columns: descriptions, prompts, memory strings, model output and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import humanize, humanize_predicate

SPACE = r"\s"


def strip(text: Column) -> Column:
    """Without white space at either end (all white space, not only blanks)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# ---------------------------------------------------------------- descriptions


def join_state(state: Column, sep: str = "; ", people: bool = False) -> Column:
    """A state (array of p, o) as text; for tools the second item is who acts."""
    part = (lambda x: F.concat(humanize(x["o"]), F.lit(" "), humanize_predicate(x["p"]))) if people else (lambda x: F.concat(humanize_predicate(x["p"]), F.lit(" "), humanize(x["o"])))
    return F.array_join(F.transform(state, part), sep)


def describe_role(role: Column, state: Column) -> Column:
    return F.concat(humanize(role), F.lit(": "), F.when(F.size(state) == 0, "no active interactions").otherwise(join_state(state)))


def describe_tool(role: Column, state: Column) -> Column:
    return F.concat(humanize(role), F.lit(": "), F.when(F.size(state) == 0, "not in use").otherwise(join_state(state, people=True)))


def state_value(state: Column, name: str) -> Column:
    """The last item of that name in a state of (p, o)."""
    found = F.filter(state, lambda x: x["p"] == name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["o"])


def robot_label(phase: Column, step: Column, sep: str | None = None) -> Column:
    """Phase with its step, in brackets or after `sep`; empty counts as missing."""
    phase, step = F.nullif(phase, F.lit("")), F.nullif(step, F.lit(""))
    both = F.concat(phase, F.lit(" ("), step, F.lit(")")) if sep is None else F.concat(phase, F.lit(sep), step)
    return F.coalesce(both, phase, F.lit("idle"))


def describe_robot(role: Column, state: Column) -> Column:
    return F.concat(humanize(role), F.lit(": "), robot_label(state_value(state, "Phase"), state_value(state, "Step")))


def describe_union(states: Column) -> Column:
    """All distinct items of several states, sorted by their text."""
    parts = F.array_sort(F.array_distinct(F.transform(F.flatten(states), lambda x: F.concat(humanize_predicate(x["p"]), F.lit(" "), humanize(x["o"])))))
    return F.when(F.size(parts) == 0, "idle / no active interactions").otherwise(F.array_join(parts, "; "))


def is_idle(state: Column) -> Column:
    """No items, or a phase that says idle."""
    return (F.size(state) == 0) | F.coalesce(F.lower(state_value(state, "Phase")) == "idle", F.lit(False))


# ---------------------------------------------------------------- model output


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def drop_speaker(text: Column) -> Column:
    """Without a leading assistant, user and system line, tested in this order."""
    for name in ("assistant", "user", "system"):
        text = F.when(F.lower(F.substring(text, 1, len(name) + 1)) == f"{name}\n", strip(F.substring(text, len(name) + 2, 1 << 30))).otherwise(text)
    return text


def parse_output(text: Column) -> Column:
    """Struct l0, l1, l2 of `L0: a | L1: b | L2: c`; the last part of a level wins, a missing one is empty."""
    parts = F.transform(F.split(text, r"[|]"), strip)

    def level(name: str) -> Column:
        found = F.filter(parts, lambda p: p.startswith(f"{name}:"))
        return F.when(F.size(found) > 0, strip(F.substring(F.element_at(found, -1), 4, 1 << 30))).otherwise("")

    return F.struct(level("L0").alias("l0"), level("L1").alias("l1"), level("L2").alias("l2"))


def answer(l0: Column, l1: Column, l2: Column) -> Column:
    return F.concat(F.lit("L0: "), l0, F.lit(" | L1: "), l1, F.lit(" | L2: "), l2)


def clean_ids(ids: Column) -> Column:
    """Ids without white space and brackets around them."""
    return F.transform(ids, lambda x: F.regexp_replace(strip(x), r"^[\[\]]+|[\[\]]+$", ""))


def json_array(text: Column, schema: str) -> Column:
    """A JSON array in model output: inside a fence if there is one, else the text, else from the first [ to the last ].

    Null where nothing parses. The parser must consume a whole array, so trailing words send a text to the bracket rule.
    """
    trimmed = strip(text)
    fence = F.regexp_extract(trimmed, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    body = F.when(trimmed.rlike(r"(?s)```(?:json)?\s*\n?.*?```"), strip(fence)).otherwise(trimmed)
    bracket = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    whole = F.when(body.startswith("[") & body.endswith("]"), F.from_json(body, schema))
    return F.coalesce(whole, F.when(bracket != "", F.from_json(bracket, schema)))


# ---------------------------------------------------------------- memory and samples


# Fixed values of the memory format: the marks around the block and its two headings; shares of the augmentation.
MEMORY_START, MEMORY_END = "<memory_start>", "<memory_end>"
LONG, SHORT = "Long: ", "Short: "
NO_MEMORY, SHORT_ONLY, LONG_ONLY = 0.5, 0.667, 0.833


def change(action: Column, level: str, text: Column) -> Column:
    return F.concat(action, F.lit(f"{level}:"), text)


def memory_string(long: Column, short: Column, include_long: bool | Column = True, include_short: bool | Column = True) -> Column:
    """The memory block of a prompt; empty if nothing is included."""
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = F.array_compact(
        F.array(
            F.when(flag(include_long) & (F.size(long) > 0), F.concat(F.lit(LONG), F.array_join(long, "; "))),
            F.when(flag(include_short) & (F.size(short) > 0), F.concat(F.lit(SHORT), F.array_join(short, "; "))),
        )
    )
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit(f"{MEMORY_START}\n"), F.array_join(parts, "\n"), F.lit(f"\n{MEMORY_END}")))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone: the first 32 bits of the MD5 of their text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long") / float(1 << 32)


def augment_memory(seed: int, key: Column, long: Column, short: Column) -> Column:
    """Half of the strings empty, a sixth each short, long or both; entries kept with probability one half."""
    roll = uniform(seed, key)
    keep = lambda tag, array: F.filter(array, lambda x, i: uniform(seed + 1, key, F.lit(tag), i) > 0.5)
    return F.when(roll < NO_MEMORY, "").otherwise(memory_string(keep("long", long), keep("short", short), roll >= SHORT_ONLY, (roll < SHORT_ONLY) | (roll >= LONG_ONLY)))


def augment_views(seed: int, key: Column, views: Column) -> Column:
    """Views in a random order, each dropped with probability one half, never all."""
    ordered = F.transform(F.array_sort(F.transform(views, lambda v, i: F.struct(uniform(seed, key, i).alias("u"), v.alias("v")))), lambda x: x["v"])
    kept = F.filter(ordered, lambda v, i: uniform(seed + 1, key, v) >= 0.5)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(ordered, 1, 1))


def strip_memory(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<memory_start>.*?<memory_end>\n?", "")


def strip_image_tokens(text: Column) -> Column:
    return F.regexp_replace(text, r"^(<image>\s*)+", "")


# The question about a frame, and the image tokens of its three forms.
QUESTION = "Describe the current activity hierarchy for this role."
IMAGE_TOKENS = {"sample": "<image>\n", "wrapped": "<im_start><image><im_end>\n", "repeated": "<image>"}


def prompt(role: Column, memory: Column, n_images: Column | int = 1, form: str = "sample") -> Column:
    """A frame's question: image tokens, the role, the memory block if there is one, and what is asked.

    form: "sample" has one token however many views, "wrapped" the same between marks, "repeated" one per view, at least one.
    """
    n = n_images if isinstance(n_images, Column) else F.lit(n_images)
    images = F.repeat(F.lit(IMAGE_TOKENS[form]), F.greatest(n.cast("int"), F.lit(1))) if form == "repeated" else F.lit(IMAGE_TOKENS[form])
    block = F.when(memory == "", "").otherwise(F.concat(memory, F.lit("\n")))
    return F.concat(images, F.lit("Role: "), role, F.lit("\n"), block, F.lit(QUESTION))


def relative_images(paths: Column, take: Column, marker: str = "processed/") -> Column:
    """Absolute paths from after `marker` on; relative ones below their take."""
    cut = lambda p: F.when(F.instr(p, marker) > 0, F.substring_index(p, marker, -1)).otherwise(p)
    return F.transform(paths, lambda p: F.when(p.startswith("/"), cut(p)).otherwise(F.when(p.startswith(F.concat(take, F.lit("/"))), p).otherwise(F.concat(take, F.lit("/"), p))))


def image_paths(frame: Column, cameras: tuple[str, ...]) -> Column:
    """colorimage/<camera>_colorimage-<frame in six digits>.jpg for each camera."""
    return F.array(*(F.format_string(f"colorimage/{c}_colorimage-%06d.jpg", frame.cast("long")) for c in cameras))


# ---------------------------------------------------------------- ids and times


def srt_seconds(time: Column) -> Column:
    """Seconds of HH:MM:SS,mmm (or a dot)."""
    part = lambda k: F.regexp_extract(time, r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})", k).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000.0


def segment_id(role: Column, level: int, number: Column) -> Column:
    return F.format_string(f"%s_L{level}_%03d", role.cast("string"), number.cast("long"))


def l2_index(l2_id: Column, fallback: Column) -> Column:
    return F.coalesce(F.regexp_extract(l2_id, r"_L2_([0-9]+)$", 1).try_cast("int"), fallback)


def duration(start: Column, end: Column) -> Column:
    return end - start + 1


def take_number(take: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(take, "_", 1)


def take_suffix(take: Column) -> Column:
    """What stands after the last underscore."""
    return F.substring_index(take, "_", -1)


# The patterns of take names and of hierarchy files.
def is_safe_name(file: Column) -> Column:
    """Is a file name one of a hierarchy, without a way out of its folder."""
    return file.rlike(r"(?Ud)^[\w\-]+_hierarchy[\w\-]*\.json$") & ~F.contains(file, F.lit(".."))


def take_of_file(file: Column) -> Column:
    """The take that a hierarchy file's name begins with, else null."""
    return F.nullif(F.regexp_extract(file, r"^(\d{3}_[A-Z]+)_hierarchy", 1), F.lit(""))


def is_take(take: Column) -> Column:
    return take.rlike(r"^\d{3}(?:[-_]\d{3})*(?:_\d+)?_(?:PKA|TKA)$")


def chat_messages(system: Column, user: Column) -> Column:
    item = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(item("system", system), item("user", user))
