"""From split packets to encoded rows ready for a classifier."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.catalog import CATALOG
from flowloom.operators import encode, flows
from flowloom.operators.columns import drop_unseen_labels
from flowloom.scale import c


@dataclass(frozen=True)
class FeatureOptions:
    mode: str = "per_split"
    cap_train: int | None = None
    cap_eval: int | None = None
    seed: int = 42
    directional: bool = True
    drop_unseen: bool = True


def cap_splits(packets: DataFrame, options: FeatureOptions, row_id: str) -> DataFrame:
    """At most the configured packets per flow, separately for the train split and the others."""
    is_train = c("split") == "train"
    train = flows.cap_packets(packets.filter(is_train), options.cap_train, options.seed, row_id)
    rest = flows.cap_packets(packets.filter(~is_train), options.cap_eval, options.seed, row_id)
    if not options.cap_train and not options.cap_eval:
        return packets
    return train.unionByName(rest)


def build_features(packets: DataFrame, row_id: str = "frame_num", options: FeatureOptions | None = None) -> DataFrame:
    """Label ids, capped packets and cleaned flow features.

    Flow statistics come from all packets of a split, and are attached to the capped ones.
    """
    options = options or FeatureOptions()
    labels = encode.label_map(packets.filter(c("split") == "train"), row_id)
    capped = cap_splits(packets, options, row_id)
    featured = flows.flow_features(capped, options.mode, row_id, full=packets)
    names = [n for n in featured.columns if n.startswith("flow_")]
    if options.directional:
        featured = flows.direction_and_gap(featured, row_id, keys=["split"])
        names += ["flow_dir_sign", "flow_iat_local"]
    cleaned = flows.clean_features(featured, names)
    labelled = encode.apply_label_map(cleaned, labels)
    return drop_unseen_labels(labelled) if options.drop_unseen else labelled


def encode_features(
    featured: DataFrame, row_id: str = "frame_num", catalog: Mapping[str, str] = CATALOG
) -> DataFrame:
    """Catalog fields encoded with a vocabulary from the train split."""
    fields = [name for name, kind in catalog.items() if kind == "categorical"]
    vocab = encode.build_vocab(featured.filter(F.col("split") == "train"), fields)
    return encode.encode_packets(featured, catalog, vocab, row_id, keep=["split", "label_id", "stream_id"])
