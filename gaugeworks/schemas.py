"""Schemas of the inputs. They are declared, never inferred: optional keys are absent, not null."""

from __future__ import annotations

MEAN = "STRUCT<mean: DOUBLE>"
STAT = "STRUCT<id: BIGINT, name: STRING, spell_name: STRING, type: STRING, actual_amount: STRUCT<mean: DOUBLE>, num_executes: STRUCT<mean: DOUBLE>>"
COLLECTED = (
    "STRUCT<dps: STRUCT<mean: DOUBLE, mean_std_dev: DOUBLE, std_dev: DOUBLE, count: BIGINT>, prioritydps: STRUCT<mean: DOUBLE>, "
    "fight_length: STRUCT<mean: DOUBLE, min: DOUBLE, max: DOUBLE>, timeline_dmg: STRUCT<mean: DOUBLE, data: ARRAY<DOUBLE>>>"
)
VARIANT_RESULT = "STRUCT<name: STRING, mean: DOUBLE, mean_stddev: DOUBLE, iterations: BIGINT, additional_metrics: ARRAY<STRUCT<metric: STRING, mean: DOUBLE>>>"
#: The names of all fields, wow_version among them, are those of the report.
PLAYER = (
    "STRUCT<dbc: MAP<STRING, STRUCT<wow_version: STRING, build_level: BIGINT, hotfix_date: STRING>>, "
    f"stats: ARRAY<{STAT}>, stats_pets: STRING, collected_data: {COLLECTED}>"
)
#: stats_pets stays text: its values are lists or objects that hold one.
REPORT = (
    "version STRING, git_revision STRING, ptr_enabled BOOLEAN, beta_enabled BOOLEAN, logs ARRAY<STRUCT<message: STRING>>, "
    f"sim STRUCT<players: ARRAY<{PLAYER}>, profilesets: STRUCT<results: ARRAY<{VARIANT_RESULT}>>>"
)
EVENT = "timestamp BIGINT, type STRING, sourceID BIGINT, sourceInstance BIGINT, targetID BIGINT, targetInstance BIGINT, abilityGameID BIGINT, amount DOUBLE"
ACTOR = "id BIGINT, gameID BIGINT, name STRING, type STRING, subType STRING, petOwner BIGINT"
ZONES = "ARRAY<STRUCT<id: BIGINT, name: STRING, frozen: BOOLEAN, encounters: ARRAY<STRUCT<id: BIGINT, name: STRING>>>>"
