"""Anonymization settings and the experiment grid."""

from __future__ import annotations

from dataclasses import dataclass

K_ANONYMITY = "k_anonymity"
DIFFERENTIAL_PRIVACY = "differential_privacy"
TOKENIZATION = "tokenization"

# Fixed values of the experiment grid.
K_VALUES = (3, 5, 10, 15)
EPSILONS = (0.1, 0.5, 1.0, 2.0)
KEY_BITS = (128, 256, 512)

_PARAMETER_OF = {K_ANONYMITY: "k", DIFFERENTIAL_PRIVACY: "epsilon", TOKENIZATION: "key_bits"}


@dataclass(frozen=True)
class Anonymization:
    """One method with its single parameter; the parameter becomes a literal of the plan."""

    method: str
    k: int | None = None
    epsilon: float | None = None
    key_bits: int | None = None

    def __post_init__(self) -> None:
        needed = _PARAMETER_OF.get(self.method)
        if needed is None:
            return  # a registered method of the user; it checks its own parameters
        if getattr(self, needed) is None:
            raise ValueError(f"{self.method} needs {needed}")
        if self.epsilon is not None and self.epsilon <= 0:
            raise ValueError("epsilon must be positive")

    @property
    def label(self) -> str:
        if self.method == K_ANONYMITY:
            return f"k={self.k}"
        if self.method == DIFFERENTIAL_PRIVACY:
            return f"eps={self.epsilon}"
        if self.method == TOKENIZATION:
            return f"{self.key_bits}-bit"
        return self.method


def k_anonymity(k: int) -> Anonymization:
    return Anonymization(K_ANONYMITY, k=k)


def differential_privacy(epsilon: float) -> Anonymization:
    return Anonymization(DIFFERENTIAL_PRIVACY, epsilon=epsilon)


def tokenization(key_bits: int) -> Anonymization:
    return Anonymization(TOKENIZATION, key_bits=key_bits)


def grid(ks=K_VALUES, epsilons=EPSILONS, key_bits=KEY_BITS) -> list[Anonymization]:
    """All settings of an experiment; extend it by passing other values."""
    return (
        [k_anonymity(k) for k in ks]
        + [differential_privacy(e) for e in epsilons]
        + [tokenization(b) for b in key_bits]
    )
