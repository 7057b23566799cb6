import json

import pytest

from tablewright.plans.registry import SchemaRegistry, schema_file_name
from tablewright.plans.resolve import binding_notes, mapping, p_value_source, resolve
from tablewright.plans.schema import STANDARD, TargetColumn, TargetSchema
from tablewright.session import scratch_path
from tablewright.sources.paths import write_text


def test_json_round_trip_keeps_every_field():
    schema = TargetSchema("s", columns=[TargetColumn("a", "float", min_value=0.0, stat_test_alpha=0.1)])
    assert TargetSchema.from_json(schema.to_json()) == schema


def test_missing_fields_take_defaults_and_unknown_types_are_refused():
    col = TargetSchema.from_dict({"name": "s", "columns": [{"name": "a"}]}).columns[0]
    assert (col.type, col.source, col.required, col.transform) == ("string", "auto", True, "none")
    with pytest.raises(ValueError):
        TargetColumn("a", "decimal")


def test_rule_text_shows_a_zero_minimum():
    assert STANDARD.rules_text().splitlines()[2] == "PValue: type=float; required=True; at_least=0.0; at_most=1.0"
    assert STANDARD.required_columns() == ["GeneSymbol", "FoldChange", "PValue"]


def test_resolution_order():
    col = TargetColumn("PValue")
    schema = TargetSchema("s", columns=[col])
    assert mapping(resolve(["p_val", "pvalue", "PValue"], schema)) == {"PValue": "PValue"}
    assert mapping(resolve(["p_val", "pvalue"], schema)) == {"PValue": "pvalue"}
    assert mapping(resolve(["x", "adj-p", "p_val"], schema)) == {"PValue": "adj-p"}
    assert resolve(["x"], schema) == {}


def test_explicit_source_does_not_fall_back():
    schema = TargetSchema("s", columns=[TargetColumn("PValue", source="q")])
    assert resolve(["PValue"], schema) == {}


def test_row_key_is_never_guessed_and_guesses_are_noted():
    bound = resolve(["row_id", "fold_name"], STANDARD)
    assert mapping(bound) == {"GeneSymbol": "fold_name", "FoldChange": "fold_name"}
    assert len(binding_notes(bound)) == 3


def test_p_value_source_prefers_the_named_column():
    col = TargetColumn("q", "float", transform="bonferroni", stat_test_source_column="raw")
    assert p_value_source(["p_val", "raw"], col) == "raw"
    assert p_value_source(["x", "p_val"], col) == "p_val"


def test_registry(spark):
    root = scratch_path(spark, "schemas")
    registry = SchemaRegistry(spark, root)
    mine = registry.create("My Schema!", [{"name": "a", "type": "int"}])
    registry.save(mine)
    write_text(spark, f"{root}/bad.json", "{not json")
    again = SchemaRegistry(spark, root)
    assert again.names() == ["Standard", "My Schema!"] and again.get("My Schema!") == mine
    assert len(again.skipped) == 1
    assert schema_file_name("My Schema!") == "my_schema_.json"
    assert not again.delete("Standard") and again.delete("My Schema!")
    assert SchemaRegistry(spark, root).names() == ["Standard"]
    assert again.table().count() == 3
    assert json.loads(mine.to_json())["columns"][0]["name"] == "a"
