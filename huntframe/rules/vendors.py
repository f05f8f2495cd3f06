"""Field names and words of the vendors' alerts.  A vendor of your own is a dict like these (``sources.libraries.read_vendor``)."""

from __future__ import annotations

# fmt: off
# Of each vendor the names of a field, first to last, and the words for severities and categories, in their order.

QAX_NGSOC = {
    'fields': {
        'ts': ['detect_time', 'event_time', 'alarm_time', 'log_time', 'occur_time', '@timestamp', 'timestamp'],
        'src_ip': ['src_ip', 'attacker_ip', 'source_address', 's_ip', 'srcip', 'src_address'],
        'dst_ip': ['dst_ip', 'victim_ip', 'dest_address', 'd_ip', 'dstip', 'dst_address', 'target_ip'],
        'dst_port': ['dst_port', 'dest_port', 'dport', 'target_port', 'victim_port'],
        'proto': ['proto', 'protocol', 'app_proto', 'l4_proto', 'transport_protocol'],
        'rule_name': ['rule_name', 'alarm_name', 'signature', 'event_name', 'policy_name', 'detect_rule_name'],
        'severity': ['severity', 'risk_level', 'alarm_level', 'threat_level', 'level'],
        'payload': ['payload', 'match_content', 'raw_log', 'packet_content', 'request_content', 'hit_content'],
        'user_agent': ['user_agent', 'http_user_agent', 'ua', 'agent'],
        'username': ['username', 'user', 'account', 'login_user', 'source_user'],
        'hostname': ['hostname', 'asset_name', 'host_name', 'dst_hostname', 'target_host', 'dev_name'],
        'action': ['action', 'disposal', 'handle_result', 'policy_action', 'verdict', 'response_action'],
    },
    'severities': {
        '紧急': 'P0', '严重': 'P0', '高危': 'P1', '高': 'P1', '中危': 'P2', '中': 'P2',
        '低危': 'P3', '低': 'P3', '提示': 'P3', 'info': 'P3', 'critical': 'P0', 'high': 'P1',
        'medium': 'P2', 'low': 'P3',
    },
    'categories': {
        'WebShell上传': 'webshell', 'WebShell通信': 'webshell', 'WebShell检测': 'webshell', '疑似WebShell': 'webshell', 'SQL注入': 'sqli', 'SQL注入攻击': 'sqli',
        '盲注': 'sqli', '命令执行': 'rce', '命令注入': 'rce', '反序列化漏洞': 'rce', '反序列化': 'rce', '反序列化攻击': 'rce',
        'Log4j2漏洞利用': 'rce', 'Fastjson反序列化': 'rce', '远程代码执行': 'rce', '暴力破解': 'brute-force', '弱口令登录': 'brute-force', '账号爆破': 'brute-force',
        '端口扫描': 'recon', '漏洞扫描': 'recon', '资产探测': 'recon', '信息泄露': 'recon', '横向移动': 'lateral', '内网渗透': 'lateral',
        '数据泄露': 'data-exfil', '数据外发': 'data-exfil', '异常外联': 'data-exfil', 'XSS跨站脚本': '其他', '文件包含': 'rce',
    },
}

SANGFOR_SIP = {
    'fields': {
        'ts': ['alarm_time', 'event_time', 'detect_time', 'log_time', 'first_time', 'last_time', '@timestamp'],
        'src_ip': ['src_ip', 'attacker_ip', 'source_ip', 'atk_src_ip', 's_ip', 'srcip', 'src_addr'],
        'dst_ip': ['dst_ip', 'victim_ip', 'target_ip', 'atk_dst_ip', 'd_ip', 'dstip', 'dst_addr'],
        'dst_port': ['dst_port', 'target_port', 'dest_port', 'victim_port', 'dport'],
        'proto': ['protocol', 'proto', 'l4_proto', 'app_protocol'],
        'rule_name': ['rule_name', 'event_name', 'alarm_name', 'threat_name', 'signature', 'sig_name'],
        'severity': ['severity', 'threat_level', 'risk_level', 'alarm_level', 'level'],
        'payload': ['payload', 'packet_content', 'request_content', 'match_content', 'evidence', 'raw_content'],
        'user_agent': ['user_agent', 'http_user_agent', 'ua'],
        'username': ['username', 'user', 'account', 'login_name'],
        'hostname': ['hostname', 'asset_name', 'dst_host', 'target_host', 'endpoint_name'],
        'action': ['action', 'disposal', 'response_action', 'block_status', 'handle_action'],
    },
    'severities': {
        '高危': 'P0', '高': 'P1', '中危': 'P2', '中': 'P2', '低危': 'P3', '低': 'P3',
        '信息': 'P3', '提示': 'P3', '4': 'P0', '3': 'P1', '2': 'P2', '1': 'P3',
        'critical': 'P0', 'high': 'P1', 'medium': 'P2', 'low': 'P3', 'info': 'P3',
    },
    'categories': {
        'Web攻击-WebShell': 'webshell', 'WebShell检测': 'webshell', 'WebShell上传': 'webshell', 'WebShell通信': 'webshell', 'Web攻击-SQL注入': 'sqli', 'SQL注入攻击': 'sqli',
        'SQL盲注': 'sqli', 'Web攻击-命令注入': 'rce', '命令执行': 'rce', '命令执行漏洞': 'rce', '远程代码执行': 'rce', '反序列化攻击': 'rce',
        'Log4j2利用': 'rce', 'Fastjson利用': 'rce', 'Struts2利用': 'rce', 'Shiro反序列化': 'rce', '暴力破解攻击': 'brute-force', '弱口令': 'brute-force',
        '账号爆破': 'brute-force', '端口扫描': 'recon', '漏洞扫描': 'recon', 'Web漏洞扫描': 'recon', '信息探测': 'recon', '横向移动': 'lateral',
        '内网横向': 'lateral', '数据泄露': 'data-exfil', '敏感信息外传': 'data-exfil', '异常外联': 'data-exfil', 'XSS攻击': '其他', '文件包含': 'rce',
        '目录遍历': '其他',
    },
}

CHANGTING_SAFELINE = {
    'fields': {
        'ts': ['event_time', 'log_time', '@timestamp', 'timestamp', 'create_time', 'ts'],
        'src_ip': ['src_ip', 'client_ip', 'remote_addr', 'source_ip', 'attacker_ip'],
        'dst_ip': ['dst_ip', 'upstream_addr', 'server_ip', 'host_ip', 'target_ip'],
        'dst_port': ['dst_port', 'server_port', 'upstream_port', 'dest_port', 'port'],
        'proto': ['proto', 'protocol', 'scheme', 'l7_proto'],
        'rule_name': ['rule_name', 'module', 'attack_type', 'event_name', 'threat_type'],
        'severity': ['severity', 'risk_level', 'level', 'action_type', 'block_reason_level'],
        'payload': ['payload', 'request', 'req_body', 'raw_request', 'body', 'matched_content'],
        'user_agent': ['user_agent', 'ua', 'http_user_agent', 'agent'],
        'username': ['user', 'username', 'account'],
        'hostname': ['host', 'hostname', 'server_name', 'domain', 'dst_host'],
        'action': ['action', 'block_action', 'disposal', 'verdict', 'decision'],
    },
    'severities': {
        '高风险': 'P0', '高危': 'P0', '高': 'P1', '中风险': 'P2', '中危': 'P2', '中': 'P2',
        '低风险': 'P3', '低危': 'P3', '低': 'P3', '提示': 'P3', '信息': 'P3', 'high': 'P1',
        'medium': 'P2', 'low': 'P3', 'critical': 'P0', 'block': 'P1', 'monitor': 'P3',
    },
    'categories': {
        'SQL注入': 'sqli', 'SQL盲注': 'sqli', '基于时间的盲注': 'sqli', '基于布尔的盲注': 'sqli', '命令注入': 'rce', '命令执行': 'rce',
        'Java反序列化': 'rce', '反序列化': 'rce', 'Fastjson反序列化': 'rce', 'Log4j2利用': 'rce', 'Spring命令执行': 'rce', 'Shiro反序列化': 'rce',
        'WebShell上传': 'webshell', 'WebShell访问': 'webshell', 'WebShell通信': 'webshell', '一句话木马': 'webshell', '暴力破解': 'brute-force', '账号爆破': 'brute-force',
        '密码爆破': 'brute-force', '扫描器识别': 'recon', '漏洞扫描': 'recon', 'Web漏洞扫描': 'recon', '信息泄露探测': 'recon', 'XSS跨站': '其他',
        '存储型XSS': '其他', '反射型XSS': '其他', '文件包含': 'rce', '文件上传绕过': 'webshell', '目录穿越': '其他', '服务端请求伪造': '其他',
        'SSRF': '其他', 'XXE': '其他', '越权访问': '其他', '敏感信息泄露': 'data-exfil',
    },
}

DBAPPSEC_MINGYU = {
    'fields': {
        'ts': ['attack_time', 'event_time', 'alarm_time', 'log_time', 'occur_time', 'timestamp', '@timestamp'],
        'src_ip': ['src_ip', 'attack_source_ip', 'source_ip', 'client_ip', 'attacker'],
        'dst_ip': ['dst_ip', 'target_ip', 'victim_ip', 'dest_ip', 'protected_ip'],
        'dst_port': ['dst_port', 'target_port', 'server_port', 'dest_port'],
        'proto': ['protocol', 'proto', 'l7_protocol', 'app_protocol'],
        'rule_name': ['rule_name', 'attack_type_name', 'event_name', 'threat_name', 'signature_name'],
        'severity': ['severity', 'threat_level', 'risk_level', 'alarm_level', 'level', 'risk_grade'],
        'payload': ['payload', 'attack_content', 'match_content', 'request_content', 'body', 'matched_data'],
        'user_agent': ['user_agent', 'http_user_agent', 'ua', 'agent_string'],
        'username': ['username', 'user', 'account', 'login_id'],
        'hostname': ['hostname', 'protected_host', 'target_domain', 'server_name', 'host'],
        'action': ['action', 'disposal', 'response_action', 'block_action', 'handle_result'],
    },
    'severities': {
        '致命': 'P0', '紧急': 'P0', '高': 'P0', '高危': 'P0', '中': 'P2', '中危': 'P2',
        '中等': 'P2', '低': 'P3', '低危': 'P3', '提示': 'P3', '信息': 'P3', '4': 'P0',
        '3': 'P1', '2': 'P2', '1': 'P3', 'critical': 'P0', 'high': 'P0', 'medium': 'P2',
        'low': 'P3',
    },
    'categories': {
        'WebShell上传': 'webshell', 'WebShell访问': 'webshell', 'WebShell后门': 'webshell', '一句话木马': 'webshell', 'Webshell管理': 'webshell', 'SQL注入攻击': 'sqli',
        'SQL注入': 'sqli', 'SQL盲注攻击': 'sqli', '联合查询注入': 'sqli', '命令注入攻击': 'rce', '命令执行': 'rce', '远程命令执行': 'rce',
        '代码执行': 'rce', '反序列化攻击': 'rce', 'Java反序列化': 'rce', 'Fastjson漏洞利用': 'rce', 'Log4j2漏洞利用': 'rce', 'Struts2漏洞利用': 'rce',
        'Spring漏洞利用': 'rce', 'Weblogic漏洞利用': 'rce', '暴力破解攻击': 'brute-force', '账号暴力破解': 'brute-force', '弱口令尝试': 'brute-force', 'Web扫描': 'recon',
        '漏洞扫描': 'recon', '目录扫描': 'recon', '端口扫描': 'recon', '敏感文件扫描': 'recon', '信息收集': 'recon', '横向移动': 'lateral',
        '数据外发': 'data-exfil', '敏感数据泄露': 'data-exfil', '异常数据传输': 'data-exfil', '跨站脚本攻击': '其他', 'XSS攻击': '其他', '文件包含攻击': 'rce',
        '目录遍历攻击': '其他', 'CSRF攻击': '其他',
    },
}

VENDORS = {
    'qax-ngsoc': QAX_NGSOC,
    'sangfor-sip': SANGFOR_SIP,
    'changting-safeline': CHANGTING_SAFELINE,
    'dbappsec-mingyu': DBAPPSEC_MINGYU,
}
# fmt: on
