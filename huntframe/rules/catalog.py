"""The rules: severity, category and probability of a false alarm of each."""

from __future__ import annotations

from typing import NamedTuple

OTHER = "其他"


class Rule(NamedTuple):
    rule_id: str
    severity: str
    category: str
    fp: float

    @property
    def action(self) -> str:
        return ACTIONS.get(self.category, ACTIONS[OTHER])


#: What to do first, by category (our own wording).
ACTIONS = {
    "recon": "Watch or block the source; review everything else it asked for",
    "brute-force": "Block the source; check whether a log-in succeeded and change the password",
    "sqli": "Block the source; check that the endpoint binds its parameters; keep the database's state",
    "rce": "Start incident response: isolate the host, keep its memory and process list",
    "webshell": "Start incident response: keep and remove the file, trace how it was uploaded",
    "lateral": "Confirm the change with its owner; else freeze the account and look at its sessions",
    "c2": "Block the destination; look at the host for the process that connects",
    "tunnel": "Block the tunnel's server; find the client process",
    "data-exfil": "Check the destination against known business traffic; keep a capture",
    OTHER: "Look at it together with the source's other findings",
}

# Rule, severity, category, probability of a false alarm.
_TABLE = """
R-NGX-001 P3 recon 0.10
R-NGX-002 P2 recon 0.20
R-NGX-003 P3 recon 0.30
R-NGX-004 P3 其他 0.40
R-NGX-005 P3 其他 0.35
R-NGX-006 P2 rce 0.10
R-NGX-007 P1 sqli 0.10
R-NGX-008 P1 rce 0.05
R-NGX-009 P2 data-exfil 0.30
R-NGX-010 P3 recon 0.45
R-AUTH-001 P2 brute-force 0.15
R-AUTH-002 P0 brute-force 0.05
R-AUTH-003 P1 lateral 0.25
R-AUTH-004 P1 lateral 0.10
R-AUTH-005 P2 lateral 0.30
R-AUTH-006 P3 lateral 0.45
R-AUTH-007 P1 lateral 0.20
R-AUTH-008 P1 lateral 0.20
R-WIN-001 P2 brute-force 0.15
R-WIN-002 P0 brute-force 0.05
R-WIN-003 P1 lateral 0.30
R-WIN-004 P1 lateral 0.10
R-WIN-005 P0 lateral 0.05
R-WIN-006 P2 lateral 0.35
R-WIN-007 P0 其他 0.02
R-WIN-008 P1 lateral 0.20
R-WIN-009 P1 lateral 0.20
R-WIN-010 P0 rce 0.05
R-WIN-011 P0 webshell 0.05
R-WIN-012 P1 lateral 0.25
R-WIN-013 P1 lateral 0.15
R-WIN-014 P2 brute-force 0.20
R-WIN-015 P0 lateral 0.05
R-WIN-016 P1 lateral 0.20
R-WIN-017 P1 rce 0.10
R-WIN-018 P0 rce 0.05
R-WIN-019 P1 rce 0.10
R-WIN-020 P0 lateral 0.15
R-WIN-021 P1 其他 0.30
R-WIN-022 P0 lateral 0.15
R-WIN-023 P2 其他 0.25
R-WIN-024 P1 lateral 0.20
R-TRAF-001 P2 recon 0.10
R-TRAF-002 P2 recon 0.30
R-TRAF-003 P1 sqli 0.10
R-TRAF-004 P0 rce 0.05
R-TRAF-005 P1 c2 0.30
R-TRAF-006 P0 c2 0.10
R-TRAF-007 P1 c2 0.20
R-TRAF-008 P0 c2 0.15
R-TRAF-009 P2 brute-force 0.20
R-TRAF-010 P1 data-exfil 0.35
R-TRAF-011 P1 c2 0.30
R-TRAF-012 P0 webshell 0.05
R-TRAF-050 P0 c2 0.10
R-TRAF-051 P0 c2 0.10
R-TRAF-052 P1 c2 0.20
R-TRAF-053 P1 c2 0.25
R-TRAF-054 P1 c2 0.15
R-TRAF-055 P2 c2 0.35
R-TRAF-056 P2 c2 0.40
R-TRAF-057 P1 c2 0.15
R-TRAF-058 P2 c2 0.40
R-TRAF-059 P1 c2 0.20
R-TRAF-060 P3 recon 0.50
R-TRAF-061 P3 recon 0.50
R-TRAF-062 P3 recon 0.60
R-TRAF-063 P3 recon 0.50
R-TRAF-064 P2 c2 0.30
R-TRAF-065 P3 recon 0.50
R-TRAF-066 P3 recon 0.50
R-TRAF-067 P2 recon 0.35
R-TRAF-068 P3 recon 0.50
R-TRAF-069 P2 c2 0.30
R-TRAF-070 P1 c2 0.20
R-TRAF-071 P1 c2 0.25
R-TRAF-072 P1 c2 0.20
R-TRAF-073 P0 c2 0.15
R-TRAF-074 P0 c2 0.05
R-TRAF-075 P2 c2 0.40
R-TRAF-076 P1 c2 0.20
R-TRAF-077 P2 recon 0.35
R-TRAF-078 P0 c2 0.10
R-TRAF-079 P2 c2 0.35
R-TRAF-080 P2 c2 0.35
R-TRAF-081 P1 c2 0.30
R-TRAF-082 P2 c2 0.40
R-TRAF-083 P3 c2 0.50
R-TRAF-084 P2 c2 0.30
R-TRAF-085 P0 webshell 0.05
R-TRAF-086 P0 webshell 0.05
R-TRAF-087 P1 webshell 0.10
R-TRAF-088 P1 webshell 0.15
R-TRAF-089 P0 c2 0.15
R-TRAF-090 P1 recon 0.20
R-TRAF-091 P2 recon 0.20
R-TRAF-092 P2 recon 0.25
R-TRAF-093 P2 recon 0.25
R-TRAF-094 P2 recon 0.20
R-TRAF-095 P0 tunnel 0.10
R-TRAF-096 P0 tunnel 0.10
R-TRAF-097 P1 brute-force 0.25
R-TRAF-098 P1 c2 0.35
R-TRAF-101 P1 lateral 0.30
R-TRAF-102 P0 lateral 0.10
R-TRAF-103 P1 lateral 0.25
R-TRAF-104 P1 lateral 0.25
R-TRAF-201 P1 tunnel 0.30
R-TRAF-202 P1 tunnel 0.35
R-TRAF-203 P1 tunnel 0.35
R-TRAF-999 P0 c2 0.10
"""

RULES = {r[0]: Rule(r[0], r[1], r[2], float(r[3])) for r in (line.split() for line in _TABLE.strip().splitlines())}
