"""Fixed schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _B, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Enum names, lower case.
IOC_TYPES = ("ip", "cidr", "domain", "url", "email")
DIRECTIONS = ("rx", "tx")
SOURCES = ("pcap", "frame_ioc", "dns_ioc", "netflow_ioc", "sflow_ioc", "udp_syslog", "tcp_syslog")
CONNECTION_TYPES = ("cidr_src", "cidr_dst", "ip", "icmp", "tcp", "udp", "dns", "url")

#: An event as it arrives in JSON, under its wire names; unknown names are ignored, missing ones null.
WIRE = _struct(
    time=_S, sensor=_S, port_id=_I, source=_S, self=_S, seq_num=_L, agentip=_S, agent_ip=_S, bytes=_L, packets=_L, crc32=_L,
    difindex=_I, sifindex=_I, dip=_S, sip=_S, direction=_S, dmac=_S, smac=_S, dns_name=_S, dport=_I, sport=_I, dst_as=_L, src_as=_L,
    dst_masklen=_I, src_masklen=_I, engine_id=_S, engine_type=_S, eth_type=_I, flow_sec=_L, flow_usec=_L, flow_start_sec=_L,
    flow_start_msec=_L, flow_stop_sec=_L, flow_stop_msec=_L, gatewayip=_S, icmp_type=_I, icmp_code=_I, ip_protocol=_I, ip_tos=_I,
    ip_ttl=_I, ttl=_I, tcp_flags=_I, type=_S, value=_S, dns=_S, file_id=_L, ioc_id=_L, ip=_S, threat_type=_S, l4_length=_I,
    length=_I, message=_S, netflow_version=_I, source_id=_L, sys_time_sec=_L, sys_time_nsec=_L, sys_uptime_sec=_L,
    sys_uptime_msec=_L, tag=_I,
)

#: The rows of an indicator file, in the order of its columns.
IOC_CSV = _struct(id=_L, type=_S, threat_type=_S, ip=_S, dns=_S, value=_S)
IOC = _struct(file_id=_L, line=_L, id=_L, type=_S, threat_type=_S, ip=_S, dns=_S, value=_S)

DNS_ANSWER = _struct(type=_S, name=_S, ip=_S)
#: Answers that a decoded message holds at most.
MAX_ANSWERS = 8

FLOW = _struct(
    version=_I, exporter=_S, source_id=_L, flow_sequence=_L, sys_uptime_ms=_L, unix_secs=_L, unix_nsecs=_L, engine_type=_I,
    engine_id=_I, src_ip=_S, dst_ip=_S, gateway_ip=_S, if_in=_L, if_out=_L, packets=_L, bytes=_L, flow_start=_L, flow_finish=_L,
    src_port=_I, dst_port=_I, tcp_flags=_I, protocol=_I, tos=_I, src_as=_L, dst_as=_L, src_mask=_I, dst_mask=_I,
)
#: What a packet's sets are told by: templates (kind 0) with their fields, data (kind 1) with their bytes, in order.
FLOW_SET = _struct(
    exporter=_S, seq_num=_L, pos=_I, source=_L, number=_I, kind=_I, fields=_S, version=_I, sys_uptime_ms=_L, unix_secs=_L, flow_sequence=_L,
    body=T.BinaryType(),
)

FRAME = _struct(
    smac=_S, dmac=_S, eth_type=_I, family=_I, sip=_S, dip=_S, ip_protocol=_I, ttl=_I, tos=_I, l4_length=_I, sport=_I, dport=_I,
    tcp_flags=_I, icmp_type=_I, icmp_code=_I, payload=T.BinaryType(),
)

SFLOW = _struct(
    agent_ip=_S, agent_sub_id=_L, packet_seq_num=_L, sys_up_time=_D, sample_type=_S, sample_format=_I, sample_seq_num=_L, ds_type=_L,
    ds_index=_L, sample_rate=_L, sample_pool=_L, drop_count=_L, input_port=_L, output_port=_L, smac=_S, dmac=_S, eth_type=_I,
    rx_vlan=_L, tx_vlan=_L, sip=_S, dip=_S, natsip=_S, natdip=_S, next_hop=_S, ip_protocol=_I, ttl=_I, sport=_I, dport=_I, natsport=_I,
    natdport=_I, tcp_flags=_I, src_user=_S, dst_user=_S, url=_S, host=_S, packet_length=_L, header_length=_L, stripped_length=_L,
    counters=T.MapType(_S, _L), skipped=T.ArrayType(_S),
)
