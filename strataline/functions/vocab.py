"""Dimension tables of the scene-graph vocabulary, and their use as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity ids and their names, predicate ids and their phrases, roles, tools, and what verbs imply.
ENTITY_NAMES = {
    "patient": "patient",
    "nurse": "scrub nurse",
    "mps": "robot technician (MPS)",
    "instrument_table": "instrument table",
    "anest": "anaesthetist",
    "ot": "operating table",
    "drape": "surgical drape",
    "circulator": "circulator nurse",
    "head_surgeon": "head surgeon",
    "ae": "anaesthesia equipment",
    "assistant_surgeon": "assistant surgeon",
    "instrument": "surgical instrument",
    "mps_station": "MPS workstation",
    "mako_robot": "Mako robotic arm",
    "monitor": "monitor",
    "tracker": "infrared tracker",
    "saw": "bone saw",
    "drill": "drill",
    "c_arm": "C-arm",
    "hammer": "hammer",
    "unrelated_person": "unrelated person",
    "robot_setup": "robot setup (physical)",
    "robot_monitor": "robot monitor (Mako screen)",
}
PREDICATE_NAMES = {
    "CloseTo": "is close to",
    "LyingOn": "is lying on",
    "Holding": "is holding",
    "Manipulating": "is manipulating",
    "Preparing": "is preparing",
    "Assisting": "is assisting",
    "Touching": "is touching",
    "Calibrating": "is calibrating",
    "Drilling": "is drilling",
    "Sawing": "is sawing",
    "Hammering": "is hammering",
    "Suturing": "is suturing",
    "Cutting": "is cutting",
    "Cementing": "is cementing",
    "Cleaning": "is cleaning",
    "Scanning": "is scanning",
}
PASSIVE = ("CloseTo", "LyingOn")
ROLES = ("head_surgeon", "assistant_surgeon", "nurse", "circulator", "anest", "mps", "unrelated_person")
TOOLS = ("saw", "drill", "hammer", "c_arm", "tracker", "instrument")
ROBOTS = ("robot_setup", "robot_monitor")
VERB_TOOL = {"Sawing": "saw", "Drilling": "drill", "Hammering": "hammer", "Scanning": "c_arm"}
CAMERAS = {"azure": "camera01", "simstation": "camera02", "trackercam": "camera03", "tracker": "camera04"}

# The recordings of each split.
TAKE_SPLITS = {
    "train": ("001_PKA", "002_PKA", "003_TKA", "004_PKA", "005_TKA", "006_PKA", "007_TKA", "008_PKA", "009_TKA"),
    "val": ("010_PKA", "011_TKA", "013_PKA"),
    "test": ("014_PKA", "033_PKA", "035_PKA", "036_PKA", "037_TKA", "038_TKA"),
}

ACTIVE = tuple(p for p in PREDICATE_NAMES if p not in PASSIVE)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """table[key], null where the key is unknown."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def humanize(entity: Column, names: dict[str, str] = ENTITY_NAMES) -> Column:
    """The entity's name; an unknown id with underscores as spaces."""
    return F.coalesce(lookup(entity, names), F.replace(entity, F.lit("_"), F.lit(" ")))


def humanize_predicate(predicate: Column, names: dict[str, str] = PREDICATE_NAMES) -> Column:
    """The predicate's phrase; an unknown id as it is."""
    return F.coalesce(lookup(predicate, names), predicate)
