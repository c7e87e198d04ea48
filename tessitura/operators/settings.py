"""Accounts, devices and their settings."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Settings with their kinds and ranges, and the defaults of accounts and devices.
CHOICES = {"sing_mode": ("inst", "orig"), "reverb": ("none", "room", "ktv", "hall", "church"), "view": ("list", "grid")}
RANGES = {"accompaniment_volume": (0, 100), "guide_volume": (0, 100), "mic_volume": (0, 200), "output_volume": (0, 100)}
FLAGS = ("mic_monitor", "howl_guard")
TEXTS = {"audio_input": 200, "audio_output": 200}
ACCOUNT_DEFAULTS = {"sing_mode": "inst", "reverb": "ktv", "view": "list", "accompaniment_volume": "100", "guide_volume": "0", "mic_monitor": "true", "mic_volume": "110", "howl_guard": "true"}
DEVICE_DEFAULTS = {"output_volume": "100", "audio_input": "", "audio_output": ""}
ROLES = ("controller", "player", "screen", "microphone")
MOST_DEVICES = 24


def valid_setting(key: Column, value: Column) -> Column:
    """Whether a JSON value (as text; strings in quotes) is allowed for a key. A flag is not a number."""
    case = F.when(F.lit(False), F.lit(False))
    for name, choices in CHOICES.items():
        case = case.when(key == name, value.isin(*(f'"{c}"' for c in choices)))
    for name, (low, high) in RANGES.items():
        case = case.when(key == name, value.rlike(r"^-?\d{1,9}$") & value.try_cast("int").between(low, high))
    case = case.when(key.isin(*FLAGS), value.isin("true", "false"))
    for name, most in TEXTS.items():
        case = case.when(key == name, value.rlike(f'^"[^"\\x00-\\x1f\\x7f]{{0,{most}}}"$'))
    return F.coalesce(case, F.lit(False))


def parsed(text: Column) -> Column:
    """A JSON object as a map of texts; anything malformed is empty."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def allowed(settings: Column, keys: list[str]) -> Column:
    return F.map_filter(settings, lambda k, _: k.isin(keys))


def overlay(*maps: Column) -> Column:
    """Later maps win over earlier ones, whatever the session says about repeated keys."""

    def over(below: Column, above: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above)

    return reduce(over, maps)


def effective(devices: DataFrame, accounts: DataFrame) -> DataFrame:
    """Settings of each device: system defaults, under the account's, under its own; only known keys."""
    known = list(ACCOUNT_DEFAULTS | DEVICE_DEFAULTS)
    defaults = F.create_map(*[F.lit(x) for kv in (ACCOUNT_DEFAULTS | DEVICE_DEFAULTS).items() for x in kv])
    own = accounts.select("account_id", allowed(parsed(F.col("defaults")), list(ACCOUNT_DEFAULTS)).alias("_a"))
    met = devices.join(own, "account_id", "left").withColumn("_a", F.coalesce("_a", F.create_map().cast("map<string,string>")))
    return met.withColumn("effective", overlay(defaults, F.col("_a"), allowed(parsed(F.col("overrides")), known))).drop("_a")


def roles(listed: Column) -> Column:
    """Known roles in order, each once."""
    return F.array_distinct(F.filter(listed, lambda r: r.isin(*ROLES)))


def roles_valid(listed: Column) -> Column:
    return F.forall(listed, lambda r: r.isin(*ROLES))


def register(devices: DataFrame, visits: DataFrame) -> DataFrame:
    """Merge visits (account_id, device_id, at): known devices are touched, new ones added up to MOST_DEVICES, oldest first.

    A new device's label counts the account's devices.
    """
    last = visits.groupBy("account_id", "device_id").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    met = devices.join(last, ["account_id", "device_id"], "full_outer")
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.coalesce("created_at", "_first"), "device_id"))
    return (
        met.withColumn("_n", place)
        .where(F.col("created_at").isNotNull() | (F.col("_n") <= MOST_DEVICES))
        .withColumn("label", F.coalesce("label", F.concat(F.lit("device "), F.col("_n"))))
        .withColumn("created_at", F.coalesce("created_at", "_first"))
        .withColumn("last_seen_at", F.greatest("last_seen_at", "_last"))
        .drop("_n", "_first", "_last")
    )


def public_devices(devices: DataFrame, accounts: DataFrame, current: str | None = None) -> DataFrame:
    """Device rows as shown: known roles, whether preferred and current; oldest first."""
    own = accounts.select("account_id", "preferred_player")
    shown = devices.join(own, "account_id", "left").withColumn("roles", roles(F.coalesce(F.from_json("roles", "array<string>"), F.array().cast("array<string>"))))
    shown = shown.withColumn("preferred", F.col("device_id").eqNullSafe(F.col("preferred_player"))).withColumn("current", F.col("device_id").eqNullSafe(F.lit(current)))
    return shown.orderBy("account_id", "created_at", "device_id")


def device_profile(devices: DataFrame, account_id: str, device_id: str) -> DataFrame:
    """Label and known roles of one device of one account; no row if there is none."""
    own = devices.where((F.col("account_id") == account_id) & (F.col("device_id") == device_id))
    listed = F.coalesce(F.from_json("roles", "array<string>"), F.array().cast("array<string>"))
    return own.select("label", F.filter(listed, lambda r: r.isin(*ROLES)).alias("roles"))


def updated_devices(devices: DataFrame, changes: DataFrame) -> DataFrame:
    """Devices after at most one change of each (account_id, device_id, expected, label, roles, overrides, clear; null fields stay), with what came of it.

    A change that expects another revision is a "conflict". Overrides are merged into the device's own, or replace them
    with clear; only a device's keys stay. Label and roles (JSON) are replaced, and the revision grows.
    """
    known = list(ACCOUNT_DEFAULTS | DEVICE_DEFAULTS)
    ask = changes.select("account_id", "device_id", F.col("expected").alias("_e"), *(F.col(c).alias(f"_{c}") for c in ("label", "roles", "overrides", "clear")))
    met = devices.join(ask, ["account_id", "device_id"], "left")
    fits = F.coalesce(F.col("_e") == F.col("revision"), F.lit(False))
    base = F.when(F.coalesce("_clear", F.lit(False)), F.create_map().cast("map<string,string>")).otherwise(parsed(F.col("overrides")))
    merged = F.to_json(allowed(overlay(base, parsed(F.col("_overrides"))), known))
    return met.withColumns({
        "said": F.when(F.col("_e").isNull(), "same").when(fits, "changed").otherwise("conflict"),
        "label": F.when(fits, F.coalesce("_label", "label")).otherwise(F.col("label")),
        "roles": F.when(fits, F.coalesce("_roles", "roles")).otherwise(F.col("roles")),
        "overrides": F.when(fits & F.col("_overrides").isNotNull(), merged).otherwise(F.col("overrides")),
        "revision": F.col("revision") + fits.cast("int"),
    }).drop("_e", "_label", "_roles", "_overrides", "_clear")


def without_lost_players(accounts: DataFrame, devices: DataFrame) -> DataFrame:
    """Accounts whose preferred player is no longer a device with the role of a player have none, and one revision more."""
    players = devices.where(F.array_contains(F.coalesce(F.from_json("roles", "array<string>"), F.array().cast("array<string>")), "player"))
    held = players.select("account_id", F.col("device_id").alias("preferred_player"), F.lit(True).alias("_held")).distinct()
    met = accounts.join(held, ["account_id", "preferred_player"], "left")
    lost = F.col("preferred_player").isNotNull() & F.col("_held").isNull()
    return met.withColumns({"revision": F.col("revision") + lost.cast("int"), "preferred_player": F.when(~lost, F.col("preferred_player"))}).select(*accounts.columns)


def preferred_exists(accounts: DataFrame, devices: DataFrame) -> DataFrame:
    """Accounts whose preferred player is one of their devices."""
    return accounts.join(devices.select("account_id", F.col("device_id").alias("preferred_player")), ["account_id", "preferred_player"], "left_semi")


ACCOUNT_STATE = "account_id string, revision int, defaults string, preferred_player string, accepted int, refused int"


def fold_account(commands: list[dict], state: dict | None = None) -> dict:
    """Accounts after ordered commands (action, expected, payload JSON, device_id): an unexpected revision is refused.

    Actions: defaults merges settings (null removes one), prefer sets the preferred player, remove_device clears it if it is that device.
    """
    state = state or {"revision": 0, "defaults": {}, "preferred_player": None, "accepted": 0, "refused": 0}
    for c in commands:
        expected = c.get("expected")
        if expected is not None and expected == expected and int(expected) != state["revision"]:
            state["refused"] += 1
            continue
        if c["action"] == "defaults":
            patch = json.loads(c["payload"] or "{}")
            merged = state["defaults"] | {k: v for k, v in patch.items() if k in ACCOUNT_DEFAULTS}
            state["defaults"] = {k: v for k, v in merged.items() if v is not None}
        elif c["action"] == "prefer":
            state["preferred_player"] = c["device_id"]
        elif c["action"] == "remove_device" and state["preferred_player"] == c["device_id"]:
            state["preferred_player"] = None
        state["revision"] += 1
        state["accepted"] += 1
    return state


def accounts_after(commands: DataFrame) -> DataFrame:
    """State of each account after its commands (account_id, seq, action, expected, payload, device_id)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("seq").astype(object).where(lambda d: d.notna(), None).to_dict("records")
        s = fold_account(rows)
        return pd.DataFrame([(rows[0]["account_id"], s["revision"], json.dumps(s["defaults"], sort_keys=True), s["preferred_player"], s["accepted"], s["refused"])], columns=[f.split()[0] for f in ACCOUNT_STATE.split(", ")])

    return commands.groupBy("account_id").applyInPandas(run, ACCOUNT_STATE)
