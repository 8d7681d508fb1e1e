"""Names, lookup tables, patterns and message texts.

Everything in this module is data that results are compared on. Logic lives in
the operators.
"""

from __future__ import annotations

# Feature names, in matrix order.
BASE_FEATURES = ["connections", "bytes", "packets", "packet_size", "ports"]
RATIO_FEATURES = ["bytes_per_packet", "bytes_per_connection", "packets_per_connection"]
LOG_FEATURES = [f"log1p_{name}" for name in BASE_FEATURES]
FEATURES = BASE_FEATURES + RATIO_FEATURES + LOG_FEATURES

# Window metadata columns, in output order.
WINDOW_METADATA = [
    "window_id", "window_start", "window_end", "time_window", "src_ip", "source_ip",
    "event_count", "protocol", "action", "interface", "destination_ip_count",
    "destination_ip_sample", "destination_port_min", "destination_port_max",
    "destination_port_count", "common_destination_ports", "tcp_syn_count",
    "tcp_pa_count", "tcp_flags_summary", "blocked_count", "passed_count",
]

# Raw flow column -> base feature.
RAW_FLOW_COLUMNS = {
    "Flow Duration": "connections",
    "Total Length of Fwd Packets": "bytes",
    "Total Fwd Packets": "packets",
    "Average Packet Size": "packet_size",
    "Destination Port": "ports",
}
# Label column candidates, first present wins.
LABEL_COLUMNS = ["label", "Label", "final_anomaly", "anomaly", "is_anomaly", "target"]
# Benign labels of the training reader (upper-cased, trimmed text).
BENIGN_LABELS_UPPER = ["BENIGN", "NORMAL", "NORMAL_TRAFFIC", "NORMAL TRAFFIC", "0"]
# Benign labels of the dataset preparation (case-sensitive).
BENIGN_LABELS_EXACT = ["BENIGN", "Benign", "benign", "Normal", "normal", "NORMAL", "0", "0.0"]
# key=value aliases -> base feature.
KEY_ALIASES = {
    "connections": ["connections", "conn", "flow_duration"],
    "bytes": ["bytes", "total_bytes"],
    "packets": ["packets", "total_packets"],
    "packet_size": ["packet_size", "avg_packet_size"],
    "ports": ["ports", "port", "destination_port", "dst_port"],
}

# Log format.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
UNUSUAL_SPACE_PATTERN = r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0]"
HEADER_PATTERN = (
    r"(?d)^([A-Z][a-z]{2}\s+\d{1,2}\s+\d\d:\d\d:\d\d"
    r"|\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
    r"\s+(\S+)\s+([^:]+):\s*(.*)$"
)
PREFIX_PATTERN = r"(?id)filterlog(?:\[\d+\])?\s*:\s*(.*)$"
KEY_VALUE_PATTERN = r"([A-Za-z_]+)\s*=\s*([0-9]+(?:\.[0-9]+)?)"
PROTOCOL_NAMES = {1: "icmp", 6: "tcp", 17: "udp", 58: "icmpv6"}
TCP_FLAGS = [
    "S", "SA", "A", "PA", "FA", "FPA", "R", "RA", "FPU", "SYN", "ACK", "RST", "FIN", "PSH",
]
FLAG_FIELD_PATTERN = r"(?:^|,)(" + "|".join(TCP_FLAGS) + r")(?=,|$)"

# Parser message texts.
PARSE_ERRORS = {
    "blank": "Linha vazia.",
    "other_syslog": "Linha syslog lida, mas nao corresponde ao filterlog do pfSense.",
    "unknown": "Linha nao reconhecida como syslog ou payload de filterlog.",
    "no_payload": "Payload CSV do filterlog nao encontrado.",
    "short_payload": "Payload CSV do filterlog muito curto.",
    "ip_version": "Versao IP nao reconhecida no payload do filterlog.",
    "missing_prefix": "Campos obrigatorios ausentes para parse completo: ",
    "missing_suffix": ".",
}

# Defaults of a normalised event.
EVENT_DEFAULTS = {
    "source_ip": "unknown_source",
    "protocol": "unknown_protocol",
    "action": "unknown_action",
    "interface": "unknown_interface",
    "destination_ip": "unknown_destination",
}

# Service ports used by the behaviour rules.
SAFE_PORTS = [53, 80, 123, 443]
SENSITIVE_PORTS = [21, 22, 23, 25, 110, 143, 445, 3389]

# Attack families.
ATTACK_TYPES = [
    "normal", "port_scan", "brute_force", "ssh_suspicious", "syn_flood", "ddos", "unknown_anomaly",
]
ATTACK_ALIASES = {
    "": "normal",
    "none": "normal",
    "anomalous_unknown": "unknown_anomaly",
    "unknown": "unknown_anomaly",
    "unknown_attack": "unknown_anomaly",
    "anomaly": "unknown_anomaly",
}
SUPPORTIVE_TYPES = ["unknown_anomaly", "ddos", "syn_flood"]
CONTEXTUAL_TYPES = ["port_scan", "brute_force", "ssh_suspicious"]

# Reason texts of the behaviour rules.
RULE_REASONS = {
    "port_scan": "Muitas conexoes SYN para muitas portas de destino em uma janela curta sugerem atividade de port scan.",
    "syn_flood": "Predominio de pacotes SYN pequenos e bloqueados para poucas portas e poucos destinos e compativel com syn flood.",
    "ddos": "Volume anormalmente alto de conexoes, bytes ou pacotes sugere padrao compativel com DDoS.",
    "brute_force": "Tentativas repetidas e bloqueadas em porta sensivel, especialmente SSH, sao compativeis com brute force.",
    "ssh_suspicious": "Bloqueios repetidos em porta de administracao, especialmente 22/TCP, indicam atividade SSH suspeita.",
    "unknown_anomaly": "O grupo apresentou bloqueios e padroes de flags ou portas fora do esperado, mas sem assinatura heuristica forte para uma familia especifica.",
    "safe_services": "Padrao compativel com trafego benigno de saida em portas comuns, sem assinatura forte de varredura ou bloqueio.",
    "no_rule": "Nenhuma regra comportamental forte foi acionada.",
}
CONTEXT_REASON_PREFIX = (
    "Janela SSH bloqueada de baixo volume, mas correlacionada em ate 120 segundos com uma janela forte "
    "de brute force da mesma origem, destino, protocolo, acao e porta 22. "
    "Regra: ssh_brute_force_context_v1. Motivo original: "
)

# AI-support criteria and texts.
AI_SUPPORT_VERSION = "ai_support_v1"
AI_SUPPORT_ENSEMBLE = 0.05
AI_SUPPORT_AE_RAW = 1.0
AI_SUPPORT_IF_NORMALIZED = 0.82
AI_SUPPORT_REASONS = {
    "strong": "ensemble_score, autoencoder_score e score_if_normalized atingiram os limiares conservadores de suporte da IA; metadado auxiliar sem alterar final_label, attack_type ou risk_level.",
    "moderate": "ensemble_score atingiu o limiar calibrado de suporte da IA; metadado auxiliar sem alterar final_label, attack_type ou risk_level.",
    "none": "Nenhum criterio calibrado de suporte da IA foi atingido; a decisao final permanece inalterada.",
}

# Reason texts of the decision rules.
DECISION_REASONS = {
    "signature_flood": "A heuristica reconheceu uma assinatura forte de flood em logs reais do pfSense e preservou o alerta.",
    "signature_port_scan": "A heuristica reconheceu um padrao forte de port scan usando portas, flags e repeticao de conexoes do pfSense.",
    "signature_brute_force": "A heuristica reconheceu repeticao bloqueada em porta sensivel do pfSense e promoveu o caso como brute force.",
    "signature_ssh": "A heuristica reconheceu atividade SSH suspeita e preservou esse contexto na decisao final.",
    "c_agree": "Isolation Forest e Autoencoder concordaram e o caso ficou acima da zona segura.",
    "c_high_suppressed": "O Autoencoder entrou em zona alta, mas o contexto heuristico pertence a uma familia com alto falso positivo e bloqueou o alerta neste perfil conservador.",
    "c_high": "O Autoencoder entrou em zona alta de anomalia e o contexto nao indicou uma familia conhecida por ruido excessivo.",
    "c_medium_suppressed": "O Autoencoder entrou na zona media, mas o contexto heuristico pertence a uma familia com historico forte de falso positivo.",
    "c_medium_supported": "O Autoencoder entrou na zona util de ataque e a heuristica reforcou o alerta.",
    "c_medium": "O Autoencoder entrou na zona util de ataque e o contexto nao trouxe um sinal forte de supressao.",
    "b_supportive": "A heuristica indicou um contexto coerente de ataque e o ensemble confirmou sinal suficiente para promover o caso no perfil balanceado.",
    "b_contextual": "A heuristica apontou uma familia contextual de ataque e o ensemble recebeu corroboracao suficiente dos modelos para nao suprimir o alerta.",
    "b_agree": "Isolation Forest e Autoencoder concordaram acima da zona segura, e o perfil balanceado preservou esse alerta.",
    "b_high": "O Autoencoder entrou em zona alta e houve corroboracao suficiente no ensemble, no IF ou no contexto heuristico para preservar o alerta.",
    "b_medium": "O Autoencoder entrou na zona media util de ataque e o perfil balanceado permitiu a promocao com suporte contextual suficiente.",
    "b_ensemble": "O ensemble entrou na faixa forte e recebeu apoio suficiente do IF, do Autoencoder ou do contexto heuristico para elevar o caso.",
    "safe": "O Autoencoder permaneceu na zona baixa de anomalia e nao houve sinal suficiente para elevar o caso.",
}

# Display labels.
ATTACK_LABELS = {
    "normal": "Normal", "anomaly": "Anomalia", "port_scan": "Varredura de Portas",
    "brute_force": "Força Bruta", "syn_flood": "DDoS", "ssh_suspicious": "SSH Suspeito",
    "suspicious": "Suspeito", "unknown": "Desconhecido",
}
RISK_LABELS = {
    "low": "Baixo", "medium": "Médio", "high": "Alto", "critical": "Crítico", "unknown": "Desconhecido",
}
FINAL_LABELS = {
    "normal": "Normal", "anomaly": "Anomalia", "available": "Disponível", "unavailable": "Indisponível",
    "success": "Sucesso", "suspicious": "Suspeito", "unknown": "Desconhecido",
}
SOURCE_LABELS = {
    "decision_engine": "Motor de Decisão", "ensemble": "Ensemble", "heuristic": "Heurística",
    "heuristic_signature": "Heurística", "autoencoder": "Autoencoder", "isolation_forest": "Isolation Forest",
    "safe_negative": "Sistema", "system": "Sistema", "unknown": "Desconhecida",
}
TECHNICAL_LABELS = {
    "final_label": "Classificação final", "attack_type": "Tipo de ataque", "risk_level": "Risco",
    "decision_source": "Fonte da decisão", "decision_reason": "Motivo da decisão", "confidence": "Confiança",
    "ai_support": "Apoio da IA", "autoencoder_score": "Score do Autoencoder",
    "isolation_score": "Score do Isolation Forest", "ensemble_score": "Score do Ensemble",
    "connections": "Conexões", "packets": "Pacotes", "bytes": "Bytes", "ports": "Portas",
    "protocol": "Protocolo", "action": "Ação", "window_start": "Início da janela", "window_end": "Fim da janela",
}

# Order of the result columns.
RESULT_COLUMNS = [
    "window_id", "window_start", "window_end", "src_ip", "event_count", "protocol", "action", "interface",
    "destination_ip_count", "destination_port_count", "common_destination_ports", "tcp_syn_count",
    "tcp_pa_count", "tcp_flags_summary", *FEATURES, "is_anomaly", "final_label", "attack_type", "risk_level",
    "confidence", "explanation", "decision_source", "decision_reason", "ensemble_score", "autoencoder_score",
    "isolation_score", "ai_support", "ai_support_conservative", "ai_support_type", "ai_support_level",
    "ai_support_reason", "ai_support_signals",
]

# Header and source column of the history export.
EXPORT_COLUMNS = [
    ("ID", "id"), ("Janela", "window_id"), ("Execução", "execution_id"), ("Início da janela", "window_start"),
    ("Fim da janela", "window_end"), ("Classificação", "final_label"), ("Tipo de ataque", "attack_type"),
    ("Risco", "risk_level"), ("Fonte da decisão", "decision_source"), ("Confiança", "confidence"),
    ("Apoio da IA", "ai_support"), ("Score do Ensemble", "ensemble_score"),
    ("Score do Autoencoder", "autoencoder_score"), ("Score do Isolation Forest", "isolation_score"),
    ("IP de origem", "src_ip"), ("IP de destino", "dst_ip"), ("Porta", "dst_port"), ("Protocolo", "protocol"),
    ("Ação", "action"),
]
RELEVANT_FEATURES = [
    "connections", "packets", "bytes", "ports", "bytes_per_packet", "packets_per_connection",
    "bytes_per_connection", "log1p_connections",
]

# Scenario observations.
OBSERVATIONS = {
    "calm": "Trafego benigno ficou majoritariamente normal.",
    "noisy": "Ainda ha excesso de promocao de anomalia em trafego benigno.",
    "kept": "Cenario preservou o tipo %s com risco dominante %s.",
    "lost": "Cenario ainda nao preservou um tipo de ataque final especifico.",
}
