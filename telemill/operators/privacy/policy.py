"""Privacy policy: which detectors run and what happens to what they find."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from telemill.operators.privacy.detectors import FIELD_NAME_DETECTOR

ALLOW, REMOVE, REPLACE, MASK = "Allow", "Remove", "Replace", "Mask"
SHA256, HMAC, ENCRYPT, ALERT_ONLY = "Sha256", "Hmac", "Encrypt", "AlertOnly"

# Label written to the metadata for each action.
ACTION_LABELS = {
    ALLOW: "Allow",
    REMOVE: "Removed",
    REPLACE: "Replaced",
    MASK: "Masked",
    SHA256: "SHA256",
    HMAC: "HMAC",
    ENCRYPT: "Encrypted",
    ALERT_ONLY: "AlertOnly",
}
UNCHANGED_ACTIONS = (ALLOW, ALERT_ONLY)
MASKING_ACTIONS = (MASK, SHA256, HMAC, ENCRYPT, REPLACE)

# Default action per detector; detectors not named here use the default action.
DEFAULT_ACTIONS = {
    FIELD_NAME_DETECTOR: REMOVE,
    "au.tfn": SHA256,
    "au.crn": MASK,
    "au.medicare": MASK,
    "au.ihi": MASK,
    "au.passport": MASK,
    "au.driver-licence": MASK,
    "au.abn": ALLOW,
    "au.acn": ALLOW,
    "au.dva": MASK,
    "fin.credit-card": REMOVE,
    "fin.bsb-account": MASK,
    "fin.iban": MASK,
    "fin.swift-bic": ALLOW,
    "fin.payid": MASK,
    "id.email": MASK,
    "id.phone.au": MASK,
    "id.phone.intl": MASK,
    "id.dob": MASK,
    "secret.aws": REMOVE,
    "secret.azure": REMOVE,
    "secret.entra": REMOVE,
    "secret.gcp": REMOVE,
    "secret.jwt": REMOVE,
    "secret.oauth": REMOVE,
    "secret.api-key": REMOVE,
    "secret.kubernetes": REMOVE,
    "secret.docker": REMOVE,
    "secret.database": REMOVE,
    "secret.env-var": REMOVE,
    "crypto.material": REMOVE,
    "class.security-marking": ALERT_ONLY,
}

# Detectors that stay off unless asked for.
OPT_IN_DETECTORS = frozenset(
    {"id.ip", "id.hostname", "id.username", "id.address", "id.gps", "class.security-marking"}
)

# Detector roots whose findings deserve a security event of their own.
ALERT_WORTHY = (
    FIELD_NAME_DETECTOR,
    "au.tfn",
    "au.crn",
    "au.medicare",
    "au.ihi",
    "au.passport",
    "au.driver-licence",
    "au.dva",
    "fin.credit-card",
    "fin.bsb-account",
    "fin.iban",
    "fin.payid",
    "secret.aws",
    "secret.azure",
    "secret.entra",
    "secret.gcp",
    "secret.jwt",
    "secret.oauth",
    "secret.api-key",
    "secret.kubernetes",
    "secret.docker",
    "secret.database",
    "secret.env-var",
    "crypto.material",
    "class.security-marking",
)


@dataclass(frozen=True)
class PrivacyPolicy:
    """Driver-side settings; everything here is resolved while the plan is built."""

    default_action: str = MASK
    replacement: str = "***REDACTED***"
    actions: Mapping[str, str] = field(default_factory=lambda: MappingProxyType(dict(DEFAULT_ACTIONS)))
    disabled: frozenset[str] = frozenset()
    opt_in: frozenset[str] = OPT_IN_DETECTORS
    enabled_opt_in: frozenset[str] = frozenset()
    hmac_key: bytes | None = field(default=None, repr=False)
    encryption_key: bytes | None = field(default=None, repr=False)
    emit_metadata: bool = True

    def __post_init__(self) -> None:
        unknown = {a for a in (*self.actions.values(), self.default_action) if a not in ACTION_LABELS}
        if unknown:
            raise ValueError(f"unknown privacy actions: {sorted(unknown)}")

    def enabled(self, detector_id: str) -> bool:
        """Whether the detector takes part."""
        if detector_id in self.disabled:
            return False
        return detector_id not in self.opt_in or detector_id in self.enabled_opt_in

    def action_for(self, detector_id: str) -> str:
        """Configured action, else the default one."""
        return self.actions.get(detector_id, self.default_action)

    def with_actions(self, **changes: str) -> PrivacyPolicy:
        """A copy with other actions; ids are given with ``.`` and ``-`` as ``__`` and ``_``."""
        from dataclasses import replace

        ids = {key.replace("__", ".").replace("_", "-"): value for key, value in changes.items()}
        return replace(self, actions=MappingProxyType({**self.actions, **ids}))
