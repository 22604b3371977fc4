"""Explicit schemas of landed replies; nothing is ever inferred from data."""

from __future__ import annotations

INSTRUCTION = "struct<programIdIndex:int,accounts:array<int>,data:string>"

TRANSACTIONS = (
    "signature string, feed_pos bigint, slot bigint, "
    "transaction struct<message:struct<accountKeys:array<string>,"
    "header:struct<numRequiredSignatures:int,numReadonlySignedAccounts:int,"
    "numReadonlyUnsignedAccounts:int>,"
    f"instructions:array<{INSTRUCTION}>>>, "
    "meta struct<err:string,"
    "loadedAddresses:struct<writable:array<string>,readonly:array<string>>,"
    f"innerInstructions:array<struct<instructions:array<{INSTRUCTION}>>>>"
)

SIGNATURES = "signature string, slot bigint, feed_pos bigint"

# `data` stays text: one reply form holds an array, another a bare object.
ACCOUNT_INFOS = (
    "tx_signature string, pubkeys array<string>, value array<struct<owner:string,data:string>>"
)

NOTIFICATIONS = (
    "context struct<slot:bigint>, value struct<signature:string>, received_at timestamp"
)

# Types inside an interface are a word or an object; as text both keep their form.
IDL = (
    "address string, "
    "instructions array<struct<name:string,args:array<struct<name:string,type:string>>>>, "
    "accounts array<struct<name:string>>, "
    "types array<struct<name:string,type:struct<kind:string,fields:string,"
    "variants:array<struct<name:string,fields:string>>>>>"
)
