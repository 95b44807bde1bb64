from driftspark.functions.hashing import (  # noqa: F401
    HASH_BITS,
    PERM_BITS,
    PERM_PRIME,
    hash_key,
    hash_unit,
    perm_hash,
    perm_parts,
)
