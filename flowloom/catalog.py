"""The field catalog: which dissected fields are features, and how each is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Field name and type.
CATALOG: dict[str, str] = {
    "eth.dst": "address_mac",
    "eth.dst.lg": "categorical",
    "eth.dst.ig": "categorical",
    "eth.src": "address_mac",
    "eth.src.lg": "categorical",
    "eth.src.ig": "categorical",
    "eth.type": "categorical",
    "ip.version": "categorical",
    "ip.hdr_len": "numerical",
    "ip.dsfield": "categorical",
    "ip.dsfield.dscp": "categorical",
    "ip.dsfield.ecn": "categorical",
    "ip.len": "numerical",
    "ip.id": "numerical",
    "ip.flags": "categorical",
    "ip.flags.rb": "categorical",
    "ip.flags.df": "categorical",
    "ip.flags.mf": "categorical",
    "ip.frag_offset": "numerical",
    "ip.ttl": "numerical",
    "ip.proto": "categorical",
    "ip.checksum": "numerical",
    "ip.src": "address_ipv4",
    "ip.dst": "address_ipv4",
    "tcp.srcport": "categorical",
    "tcp.dstport": "categorical",
    "tcp.stream": "numerical",
    "tcp.len": "numerical",
    "tcp.seq": "numerical",
    "tcp.seq_raw": "numerical",
    "tcp.ack": "numerical",
    "tcp.ack_raw": "numerical",
    "tcp.hdr_len": "numerical",
    "tcp.flags": "categorical",
    "tcp.flags.res": "categorical",
    "tcp.flags.ae": "categorical",
    "tcp.flags.cwr": "categorical",
    "tcp.flags.ece": "categorical",
    "tcp.flags.urg": "categorical",
    "tcp.flags.ack": "categorical",
    "tcp.flags.push": "categorical",
    "tcp.flags.reset": "categorical",
    "tcp.flags.syn": "categorical",
    "tcp.flags.fin": "categorical",
    "tcp.window_size_value": "numerical",
    "tcp.window_size": "numerical",
    "tcp.window_size_scalefactor": "numerical",
    "tcp.checksum": "numerical",
    "tcp.urgent_pointer": "numerical",
    "tcp.pdu.size": "numerical",
    "tcp.options.mss": "categorical",
    "tcp.option_kind": "categorical",
    "tcp.option_len": "numerical",
    "tcp.options.mss_val": "numerical",
    "tcp.options.wscale": "categorical",
    "tcp.options.wscale.shift": "numerical",
    "tcp.options.wscale.multiplier": "numerical",
    "tcp.options.sack_perm": "categorical",
    "tcp.options.sack_le": "numerical",
    "tcp.options.sack_re": "numerical",
    "tcp.options.timestamp": "numerical",
    "tcp.options.timestamp.tsval": "numerical",
    "tcp.options.timestamp.tsecr": "numerical",
    "tcp.reassembled_segments": "categorical",
    "tls.record.content_type": "categorical",
    "tls.record.version": "numerical",
    "tls.record.length": "numerical",
    "tls.alert_message.level": "categorical",
    "tls.alert_message.desc": "categorical",
    "tls.heartbeat_message.type": "categorical",
    "tls.heartbeat_message.payload_length": "numerical",
    "tls.handshake.type": "categorical",
    "tls.handshake.length": "numerical",
    "tls.handshake.version": "categorical",
    "tls.handshake.random_time": "numerical",
    "tls.handshake.session_id_length": "numerical",
    "tls.handshake.cipher_suites_length": "numerical",
    "tls.handshake.ciphersuite": "categorical",
    "tls.handshake.comp_methods_length": "numerical",
    "tls.handshake.comp_method": "categorical",
    "tls.handshake.extensions_length": "numerical",
    "tls.handshake.extension.type": "categorical",
    "tls.handshake.extension.len": "numerical",
    "tls.handshake.extensions_server_name_list_len": "numerical",
    "tls.handshake.extensions_server_name_type": "categorical",
    "tls.handshake.extensions_server_name_len": "numerical",
    "tls.handshake.extensions_server_name": "categorical",
    "tls.handshake.extensions_alpn_str": "categorical",
    "tls.handshake.sig_hash_alg_len": "numerical",
    "tls.handshake.sig_hash_alg": "categorical",
    "tls.handshake.certificates_length": "numerical",
    "tls.handshake.certificate_length": "numerical",
    "tls.x509af.version": "categorical",
    "tls.x509af.algorithm.id": "categorical",
    "tls.x509if.oid": "categorical",
    "tls.x509sat.printableString": "categorical",
    "tls.x509af.notBefore": "numerical",
    "tls.x509af.notAfter": "numerical",
    "tls.x509ce.KeyUsage.digitalSignature": "categorical",
    "tls.x509ce.KeyUsage.keyCertSign": "categorical",
    "tls.x509ce.KeyUsage.cRLSign": "categorical",
}


def catalog_table(spark: SparkSession) -> DataFrame:
    """(field, type) of the fixed catalog."""
    return spark.createDataFrame(list(CATALOG.items()), "field string, type string")


def fields_of_type(kind: str) -> list[str]:
    return [field for field, field_kind in CATALOG.items() if field_kind == kind]
