"""Token vocabulary, critical tokens, and the feature numbering built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.storage import small_table

# Monitored calls in feature order, and their x86-64 numbers.
SYSCALLS = [
    "execve", "clone", "open", "openat", "setuid", "setgid", "setreuid",
    "setregid", "setresuid", "setresgid", "ptrace", "mmap", "chmod", "fchmod",
    "chown", "fchown", "mount", "execveat", "prctl", "capset", "unshare",
]
SYSCALL_NUMBERS = {
    "execve": 59, "clone": 56, "open": 2, "openat": 257, "setuid": 105,
    "setgid": 106, "setreuid": 113, "setregid": 114, "setresuid": 117,
    "setresgid": 119, "ptrace": 101, "mmap": 9, "chmod": 90, "fchmod": 91,
    "chown": 92, "fchown": 93, "mount": 165, "execveat": 322, "prctl": 157,
    "capset": 125, "unshare": 272,
}
# Calls that change privilege (a pair with one of them is a feature).
CRITICAL = [
    "setuid", "setgid", "setreuid", "setregid", "setresuid", "setresgid",
    "ptrace", "capset", "mount", "unshare", "execve", "execveat", "chmod",
]
# Calls that trigger early scoring of a short process.
HIGH_RISK = [
    "setuid", "setgid", "setreuid", "setresuid", "ptrace", "capset", "unshare",
    "execve", "chmod", "chown",
]
# Calls always shown in the event digest.
IMPORTANT = [
    "execve", "setuid", "setgid", "setreuid", "setresuid", "ptrace", "mount",
    "capset", "unshare", "chmod", "chown",
]
# Process names of the build toolchain; the training and live
# denylist also drops the cron daemon.
TOOLCHAIN_COMMS = ["cc1", "gcc", "cc", "as", "ld", "collect2", "make", "cmake", "ninja"]
TRAINING_DENYLIST = TOOLCHAIN_COMMS + ["cron"]
# Programs known to belong to the attack simulation.
KNOWN_ATTACK_COMMS = [
    "suid_exploit", "rapid_chain", "stealthy", "ptrace_sim", "namespace_sim",
    "capset_sim", "cycle", "webshell_sim",
]
# Techniques every tool comparison lists.
TECHNIQUES = [
    "suid_exploit", "rapid_chain", "stealthy", "suid_discovery",
    "sensitive_file_access", "chmod_chown", "ptrace", "namespace",
    "capset_prctl", "sudo_misconfig", "cron_persistence", "ld_preload",
    "passwd_write", "webshell",
]
UNATTRIBUTED = "unattributed"


@dataclass(frozen=True)
class Vocabulary:
    """Ordered tokens; feature ``i`` counts token ``i``, then come critical pairs.

    Pairs are numbered row by row over ``tokens x tokens``, keeping those with a
    critical member. A row of a critical token is complete; any other row holds
    only the critical tokens. So a pair's number follows from three small arrays
    and needs no dictionary lookup per event.
    """

    tokens: tuple[str, ...]
    critical: frozenset[str]

    @classmethod
    def of(cls, tokens, critical) -> "Vocabulary":
        return cls(tuple(tokens), frozenset(critical))

    @property
    def flags(self) -> list[bool]:
        return [t in self.critical for t in self.tokens]

    def pairs(self) -> list[tuple[str, str]]:
        return [(a, b) for a in self.tokens for b in self.tokens if {a, b} & self.critical]

    def n_features(self, ngram: int) -> int:
        return len(self.tokens) + (len(self.pairs()) if ngram >= 2 else 0)

    def feature_names(self, ngram: int) -> list[str]:
        names = list(self.tokens)
        if ngram >= 2:
            names += [f"{a}→{b}" for a, b in self.pairs()]
        return names

    def table(self, spark: SparkSession) -> DataFrame:
        """Dimension ``(idx, token, is_critical)``; its size is fixed by the vocabulary."""
        rows = [(i, t, c) for i, (t, c) in enumerate(zip(self.tokens, self.flags))]
        return small_table(spark, rows, "idx int, token string, is_critical boolean")

    def feature_table(self, spark: SparkSession, ngram: int) -> DataFrame:
        """Dimension ``(feature_idx, feature)``."""
        rows = list(enumerate(self.feature_names(ngram)))
        return small_table(spark, rows, "feature_idx int, feature string")

    def with_index(self, events: DataFrame, token_col: str, out: str) -> DataFrame:
        """Add the token's index; NULL for tokens outside the vocabulary."""
        dim = self.table(events.sparkSession).select(F.col("idx").alias(out), F.col("token").alias("_token"))
        return events.join(F.broadcast(dim), events[token_col] == dim["_token"], "left").drop("_token")

    def pair_feature(self, left: Column, right: Column) -> Column:
        """Feature number of the pair of token indexes, NULL if it has none."""
        n = len(self.tokens)
        n_critical = sum(self.flags)
        starts, at = [], n
        for flag in self.flags:
            starts.append(at)
            at += n if flag else n_critical
        ranks = [sum(self.flags[:i]) for i in range(n)]

        def pick(values, i):
            return F.get(F.array(*[F.lit(v) for v in values]), i)

        return F.when(pick(self.flags, left), pick(starts, left) + right).when(
            pick(self.flags, right), pick(starts, left) + pick(ranks, right)
        )


SYSCALL_VOCABULARY = Vocabulary.of(SYSCALLS, CRITICAL)


def pair_dictionary(vocabulary: DataFrame) -> DataFrame:
    """``(feature_idx, a, b, feature)`` of all critical pairs of a vocabulary table.

    The vocabulary is one small array, so pairs come from exploding it twice.
    """
    entry = F.struct("idx", "token", "is_critical")
    one = vocabulary.agg(F.array_sort(F.collect_list(entry)).alias("v"))
    pairs = one.select("v", F.explode("v").alias("l")).select(F.size("v").alias("n"), "l", F.explode("v").alias("r"))
    kept = pairs.where("l.is_critical OR r.is_critical")
    # A few hundred rows at most: one window over all of them is fine.
    rank = F.row_number().over(Window.orderBy("l.idx", "r.idx"))
    return kept.select(
        (F.col("n") + rank - 1).alias("feature_idx"), F.col("l.token").alias("a"), F.col("r.token").alias("b"),
        F.concat_ws("→", "l.token", "r.token").alias("feature"),
    )
