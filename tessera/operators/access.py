"""Users, roles and grants of a store: who may do what with which table, and which rows they see."""

from __future__ import annotations

import hashlib
import hmac
import os

PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER")
#: Roles that are always there, with their privileges on all tables of their database (fixed values).
BUILT_IN = {"admin": PRIVILEGES, "owner": PRIVILEGES, "writer": ("SELECT", "INSERT", "UPDATE", "DELETE"), "reader": ("SELECT",)}


class Denied(PermissionError):
    """The user may not do this."""


def secret(password: str, salt: str | None = None) -> str:
    """A salted hash of a password; passwords are not kept."""
    salt = salt or os.urandom(16).hex()
    return f"{salt}${hashlib.pbkdf2_hmac('sha256', password.encode(), bytes.fromhex(salt), 100_000).hex()}"


def matches(password: str, known: str) -> bool:
    return hmac.compare_digest(secret(password, known.partition("$")[0]), known)


class Access:
    """What one user of a store may do. The user admin, and no user at all, may do everything."""

    def __init__(self, store, user: str):
        self.store, self.user = store, user
        if not self.free and user not in store.state["users"]:
            raise Denied(f"there is no user {user}")

    @property
    def free(self) -> bool:
        return self.user in ("", "admin")

    def roles(self) -> list[dict]:
        return self.store.state["users"][self.user]["roles"]

    def privileges(self, table: str) -> list[tuple[str, str | None]]:
        """Privileges on a table, each with its row condition or None."""
        database = table.partition(".")[0] if "." in table else "default"
        held, names = [], {self.user}
        for role in self.roles():
            if role["database"] in (None, database):
                names.add(role["role"])
                held += [(p, None) for p in BUILT_IN.get(role["role"], ())]
        for grant in self.store.state["grants"]:
            if grant["to"] in names and grant["table"] == table:
                held += [(p, grant["where"]) for p in grant["privileges"]]
        return held

    def filters(self, table: str, privilege: str) -> list[str]:
        """Conditions on the rows that the user may touch: none if some grant has none. Denied without any grant."""
        if self.free:
            return []
        conditions = [where for p, where in self.privileges(table) if p == privilege]
        if not conditions:
            raise Denied(f"{self.user} may not {privilege} {table}")
        return [] if None in conditions else [" OR ".join(f"({c})" for c in dict.fromkeys(conditions))]

    def need_admin(self) -> None:
        if not self.free and not any(r["role"] == "admin" and r["database"] is None for r in self.roles()):
            raise Denied(f"{self.user} is no administrator")

    def need(self, privilege: str, database: str) -> None:
        """A privilege that is not on a table that exists, such as CREATE: of a role for the database."""
        if not self.free and not any(r["database"] in (None, database) and privilege in BUILT_IN.get(r["role"], ()) for r in self.roles()):
            raise Denied(f"{self.user} may not {privilege} in {database}")
