import json

import pytest
from pyspark.sql import types as T

from ledgerloom.operators import catalog as cat
from ledgerloom.sources import readers
from tests import sample


def columns(spark, *documents):
    frame = spark.createDataFrame([(json.dumps(d),) for d in documents], "idl string")
    return cat.catalog_columns(frame).collect()


def test_tables_of_the_sample(spark):
    rows = columns(spark, sample.IDL)
    found = {}
    for r in sorted(rows, key=lambda r: (r.table_name, r.ordinal or 0)):
        found.setdefault(r.table_name, [])
        if r.field:
            found[r.table_name].append((r.column_name, r.sql_type, r.nullable))
    assert found == {
        "ix_deposit": [("amount", "BIGINT", False), ("memo", "TEXT", False), ("flag", "BOOLEAN", False),
                       ("metadata", "JSONB", False)],
        "ix_withdraw": [("amount", "BIGINT", False)],
        "acct_vault_account": [("authority", "VARCHAR(44)", False), ("nickname", "TEXT", True),
                               ("metadata", "JSONB", False)],
        "acct_tuple_account": [],
    }


GOLDEN = [
    ("bool", "BOOLEAN", False), ("u128", "NUMERIC(39,0)", False), ("pubkey", "VARCHAR(44)", False),
    ("bytes", "BYTEA", False), ({"option": "u64"}, "BIGINT", True), ({"vec": "u8"}, "JSONB", False),
    ({"array": ["u8", 4]}, "JSONB", False), ({"defined": {"name": "Metadata"}}, "JSONB", False),
    ({"defined": {"name": "EmptyEnum"}}, "TEXT", False), ({"defined": {"name": "RichEnum"}}, "JSONB", False),
    ({"defined": {"name": "MissingType"}}, "JSONB", False), ({"defined": "EmptyEnum"}, "TEXT", False),
    ({"option": {"option": {"defined": {"name": "EmptyEnum"}}}}, "TEXT", True),
    ({"option": {"vec": {"option": "u8"}}}, "JSONB", True), ("mystery", "JSONB", False),
    ({"coption": "u64"}, "JSONB", False), ({"generic": "T"}, "JSONB", False),
]


def test_both_forms_of_the_type_rule_agree(spark):
    args = [{"name": f"f{i}", "type": kind} for i, (kind, _, _) in enumerate(GOLDEN)]
    document = {**sample.IDL, "accounts": [], "instructions": [{"name": "all", "args": args}]}
    rows = sorted(columns(spark, document), key=lambda r: r.ordinal)
    want = [(sql, nullable) for _, sql, nullable in GOLDEN]
    assert [(r.sql_type, r.nullable) for r in rows] == want
    program = cat.Program.from_idl(document)
    assert [(f.sql_type, f.nullable) for f in program.instructions["all"]] == want
    assert [f.filter_kind for f in program.instructions["all"]] == [r.filter_kind for r in rows]


def test_last_definition_of_a_type_wins(spark):
    document = {"address": "p", "instructions": [{"name": "a", "args": [{"name": "x", "type": {"defined": "E"}}]}],
                "types": [{"name": "E", "type": {"kind": "struct", "fields": []}},
                          {"name": "E", "type": {"kind": "enum", "variants": [{"name": "A"}]}}]}
    assert columns(spark, document)[0].sql_type == "TEXT"
    assert cat.Program.from_idl(document).instructions["a"][0].sql_type == "TEXT"


def test_schemas_and_errors():
    program = cat.Program.from_idl(sample.IDL)
    fields = {f.name: (f.dataType, f.nullable) for f in program.instruction_schema("deposit")}
    assert fields["amount"] == (T.DecimalType(20, 0), False)
    assert fields["tx_signature"] == (T.StringType(), False)
    assert program.account_schema("VaultAccount")["nickname"].nullable
    assert program.account_schema("TupleAccount").names == [f.name for f in cat.ACCOUNT_BASE]
    with pytest.raises(ValueError, match="Account EnumAccount is not a struct"):
        program.account_schema("EnumAccount")
    with pytest.raises(ValueError, match="Account Nope is missing from IDL"):
        program.account_schema("Nope")
    with pytest.raises(ValueError, match="already in use"):
        cat.Program.from_idl({"address": "p", "instructions": [
            {"name": "a", "args": [{"name": "signer", "type": "u8"}]}]})


def test_discriminators(spark):
    program = cat.Program.from_idl(sample.IDL)
    rows = {r.name: r.disc for r in program.discriminators(spark).collect()}
    assert rows == {"deposit": "f223c68952e1f2b6", "withdraw": "b712469c946da122"}
    assert program.account_discriminators(spark).count() == 3


def test_reading_interfaces(spark, tmp_path):
    for name, text in (("a", json.dumps(sample.IDL, indent=2)), ("b", "{not json"), ("c", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    errors = sorted(str(r.idl_error) for r in readers.read_idl(spark, str(tmp_path)).collect())
    assert errors == ["Failed to parse IDL JSON", "IDL has no program address", "None"]
    assert cat.load_program(spark, str(tmp_path / "a.json")).program_id == sample.PROGRAM
    with pytest.raises(ValueError, match="Failed to parse IDL JSON"):
        cat.load_program(spark, str(tmp_path / "b.json"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cat.load_program(spark, str(tmp_path / "none.json"))
