"""Protected files: keys from passwords, which filter a string or stream has, and both directions. Versions 1, 2 (RC4), 4 (crypt filters) and 5 (AES-256)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from quire.functions import aes
from quire.functions.crypto import master_key, opens, owner_value, rc4_bytes, user_password, user_value, unpad

IDENTITY, RC4, AES128, AES256 = "Identity", "V2", "AESV2", "AESV3"
METHODS = {1: RC4, 2: RC4, 4: AES128, 5: AES256}


def hardened(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The hash of revision 6: at least 64 rounds, until the last byte is small enough for the round."""
    k = hashlib.sha256(password + salt + user).digest()
    number = 0
    while True:
        sealed = aes.encrypt_cbc(k[:16], k[16:32], (password + k + user) * 64)
        k = hashlib.new(("sha256", "sha384", "sha512")[sum(sealed[:16]) % 3], sealed).digest()
        number += 1
        if number >= 64 and sealed[-1] <= number - 32:
            return k[:32]


def digest5(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    return hardened(password, salt, user) if revision >= 6 else hashlib.sha256(password + salt + user).digest()


def values5(user: bytes, owner: bytes, permission: int, key: bytes, seed: bytes, revision: int = 6, metadata: bool = True) -> dict[str, bytes]:
    """U, UE, O, OE and Perms of a file key; ``seed`` (sixteen bytes or more, used once) gives the salts."""
    user, owner = user[:127], owner[:127]
    salts = hashlib.sha512(seed).digest()
    u = digest5(user, salts[:8], b"", revision) + salts[:16]
    ue = aes.encrypt_cbc(digest5(user, salts[8:16], b"", revision), bytes(16), key)
    o = digest5(owner, salts[16:24], u, revision) + salts[16:32]
    oe = aes.encrypt_cbc(digest5(owner, salts[24:32], u, revision), bytes(16), key)
    plain = (permission & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + (b"T" if metadata else b"F") + b"adb" + salts[32:36]
    return {"U": u, "UE": ue, "O": o, "OE": oe, "Perms": aes.encrypt_block(key, plain)}


def opens5(password: bytes, values: dict[str, bytes], revision: int) -> bytes | None:
    """The file key if the password is the user's or the owner's."""
    password = password[:127]
    u, o = values["U"][:48], values["O"][:48]
    if digest5(password, o[32:40], u, revision) == o[:32]:
        return aes.decrypt_cbc(digest5(password, o[40:48], u, revision), bytes(16), values["OE"][:32])
    if digest5(password, u[32:40], b"", revision) == u[:32]:
        return aes.decrypt_cbc(digest5(password, u[40:48], b"", revision), bytes(16), values["UE"][:32])
    return None


@dataclass
class Security:
    """A file key with the methods of strings and streams."""

    version: int
    revision: int
    key: bytes
    strings: str
    streams: str
    metadata: bool = True
    permission: int = -1

    def object_key(self, obj_no: int, gen_no: int, method: str) -> bytes:
        if method == AES256:
            return self.key
        seed = self.key + obj_no.to_bytes(3, "little") + gen_no.to_bytes(2, "little") + (b"sAlT" if method == AES128 else b"")
        return hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]

    def decrypted(self, data: bytes, obj_no: int, gen_no: int, method: str) -> bytes:
        if method == IDENTITY:
            return data
        key = self.object_key(obj_no, gen_no, method)
        return rc4_bytes(key, data) if method == RC4 else aes.unseal(key, data)

    def encrypted(self, data: bytes, obj_no: int, gen_no: int, method: str, nth: int = 0) -> bytes:
        if method == IDENTITY:
            return data
        key = self.object_key(obj_no, gen_no, method)
        if method == RC4:
            return rc4_bytes(key, data)
        # a vector that no other value of the file has
        iv = hashlib.sha256(self.key + b"%d %d %d" % (obj_no, gen_no, nth)).digest()[:16]
        return aes.seal(key, iv, data)

    def method_of_stream(self, kind: str | None, own_filter: str | None) -> str:
        """Index streams are never encrypted, metadata only if the file says so, and a stream may name its own filter."""
        if kind == "XRef" or kind == "Metadata" and not self.metadata or own_filter == IDENTITY:
            return IDENTITY
        return self.streams


def filter_method(filters: dict[str, str], name: str | None) -> str:
    """The method of a named crypt filter; ``Identity`` and a missing name leave data as it is."""
    if name is None or name == IDENTITY:
        return IDENTITY
    method = filters.get(name)
    if method in (None, "None"):
        return IDENTITY
    if method not in (RC4, AES128, AES256):
        raise ValueError(f"crypt filter method {method} isn't read here")
    return method


def opened(rules: dict, password: bytes, file_id: bytes) -> Security:
    """The security of an encryption dictionary in Python values, if the password opens it.

    Null or absent entries have the format's defaults. A wrong password is a PermissionError, an unknown version or filter a ValueError.
    """
    version, revision, permission = rules.get("V", 0), rules.get("R", 2), rules.get("P", -1)
    metadata = rules.get("EncryptMetadata", True) is not False
    if rules.get("Filter", "Standard") != "Standard":
        raise ValueError("only password security is read here")
    if version in (1, 2):
        key = opens(password, rules["O"], rules["U"], permission, file_id, rules.get("Length", 40) // 8 if version == 2 else 5, revision)
        strings = streams = RC4
    elif version == 4:
        strings, streams = (filter_method(rules.get("CF", {}), rules.get(k)) for k in ("StrF", "StmF"))
        key = opens4(password, rules["O"], rules["U"], permission, file_id, metadata)
    elif version == 5:
        strings, streams = (filter_method(rules.get("CF", {}), rules.get(k)) for k in ("StrF", "StmF"))
        key = opens5(password, rules, revision)
    else:
        raise ValueError(f"encryption version {version} isn't read here")
    if key is None:
        raise PermissionError("the password doesn't open the document")
    return Security(version, revision, key, strings, streams, metadata, permission)


def opens4(password: bytes, owner: bytes, user: bytes, permission: int, file_id: bytes, metadata: bool) -> bytes | None:
    for candidate in (password, unpad(user_password(password, owner, 16, 4))):
        key = master_key(candidate, owner, permission, file_id, 16, 4, metadata)
        if user_value(key, file_id, 4)[:16] == user[:16]:
            return key
    return None


def created(version: int, user: bytes = b"", owner: bytes | None = None, permission: int = -4, file_id: bytes = b"", metadata: bool = True, seed: bytes = b"", revision: int = 6) -> tuple[dict, Security]:
    """(encryption dictionary as ``syntax.dump`` takes it, security) for a new file. ``seed`` must be different for every file.

    ``revision`` 6 or 5 is for version 5: the latter's passwords are hashed once, which is much faster for reader and attacker.
    """
    owner = user if owner is None else owner
    rules: dict[str, object] = {"Filter": "/Standard", "V": version, "P": permission}
    method = METHODS.get(version)
    if method is None:
        raise ValueError(f"encryption version {version} isn't written here")
    if version == 5:
        key = hashlib.sha256(b"key" + seed + file_id).digest()
        rules |= {"R": revision, "Length": 256} | values5(user, owner, permission, key, seed + file_id, revision, metadata)
    else:
        revision, length = {1: (2, 5), 2: (3, 16), 4: (4, 16)}[version]
        o = owner_value(owner, user, length, revision)
        key = master_key(user, o, permission, file_id, length, revision, metadata)
        rules |= {"R": revision, "Length": 8 * length, "O": o, "U": user_value(key, file_id, revision)}
    if version >= 4:
        rules |= {"CF": {"StdCF": {"AuthEvent": "/DocOpen", "CFM": "/" + method, "Length": len(key)}}, "StmF": "/StdCF", "StrF": "/StdCF"}
        if not metadata:
            rules["EncryptMetadata"] = False
    return rules, Security(version, revision, key, method, method, metadata, permission)
