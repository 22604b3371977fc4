"""A small interface used across the tests."""

import struct

from ledgerloom.functions.base58 import ALPHABET

PROGRAM = "11111111111111111111111111111111"

IDL = {
    "address": PROGRAM,
    "instructions": [
        {
            "name": "deposit",
            "args": [
                {"name": "amount", "type": "u64"},
                {"name": "memo", "type": "string"},
                {"name": "flag", "type": "bool"},
                {"name": "metadata", "type": {"defined": {"name": "Metadata"}}},
            ],
        },
        {"name": "withdraw", "args": [{"name": "amount", "type": "u64"}]},
    ],
    "accounts": [{"name": "VaultAccount"}, {"name": "TupleAccount"}, {"name": "EnumAccount"}],
    "types": [
        {
            "name": "VaultAccount",
            "type": {
                "kind": "struct",
                "fields": [
                    {"name": "authority", "type": "pubkey"},
                    {"name": "nickname", "type": {"option": "string"}},
                    {"name": "metadata", "type": {"defined": {"name": "Metadata"}}},
                ],
            },
        },
        {"name": "TupleAccount", "type": {"kind": "struct", "fields": ["u64", "string"]}},
        {"name": "EnumAccount", "type": {"kind": "enum", "variants": [{"name": "Only"}]}},
        {"name": "Metadata", "type": {"kind": "struct", "fields": [{"name": "level", "type": "u64"}]}},
        {"name": "EmptyEnum", "type": {"kind": "enum", "variants": [{"name": "A"}, {"name": "B"}]}},
        {
            "name": "RichEnum",
            "type": {
                "kind": "enum",
                "variants": [{"name": "A", "fields": [{"name": "value", "type": "u64"}]}],
            },
        },
    ],
}


def base58(data: bytes) -> str:
    number, text = int.from_bytes(data, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        text = ALPHABET[digit] + text
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + text


def text(value: str) -> bytes:
    data = value.encode()
    return struct.pack("<I", len(data)) + data


def deposit(amount=11, memo="hi", flag=True, level=9) -> str:
    body = struct.pack("<Q", amount) + text(memo) + bytes([flag]) + struct.pack("<Q", level)
    return base58(bytes.fromhex("f223c68952e1f2b6") + body)


def withdraw(amount=3) -> str:
    return base58(bytes.fromhex("b712469c946da122") + struct.pack("<Q", amount))


def vault(authority=b"\1" * 32, nickname="nick", level=5) -> bytes:
    option = b"\0" if nickname is None else b"\1" + text(nickname)
    return bytes.fromhex("e6fbf1538bca5d1c") + authority + option + struct.pack("<Q", level)


def transaction(signature, slot, instructions, keys=("signer-1", PROGRAM, "vault-1"), inner=(),
                writable=("loaded-writable",), readonly=("OtherProgram",), err=None, feed_pos=0,
                header=(1, 0, 1)):
    ix = lambda rows: [
        {"programIdIndex": p, "accounts": list(a), "data": d} for p, a, d in rows
    ]
    return {
        "signature": signature, "feed_pos": feed_pos, "slot": slot,
        "transaction": {"message": {
            "accountKeys": list(keys),
            "header": {"numRequiredSignatures": header[0], "numReadonlySignedAccounts": header[1],
                       "numReadonlyUnsignedAccounts": header[2]},
            "instructions": ix(instructions)}},
        "meta": {"err": err,
                 "loadedAddresses": {"writable": list(writable), "readonly": list(readonly)},
                 "innerInstructions": [{"instructions": ix(g)} for g in inner]},
    }
