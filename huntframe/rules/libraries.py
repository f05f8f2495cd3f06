"""Rule libraries as plain tables.  All of them are fixed values; each can be replaced by a JSON file (``sources.libraries``)."""

# fmt: off
# Fixed values.

#: (id, tool, pattern, severity) of user agents of scanners and scripts.
UA_SIGNATURES = (
    ('SIG-TF-001', 'sqlmap', '(?i)sqlmap/', 'high'),
    ('SIG-TF-002', 'nuclei', '(?i)Nuclei( - Open-source project)?', 'high'),
    ('SIG-TF-003', 'xray', '(?i)\\bxray\\b', 'medium'),
    ('SIG-TF-004', 'acunetix', '(?i)(AWVS|Acunetix|wvs_scanner)', 'high'),
    ('SIG-TF-005', 'nessus', '(?i)Nessus', 'high'),
    ('SIG-TF-006', 'nikto', '(?i)Nikto', 'high'),
    ('SIG-TF-007', 'dirsearch', '(?i)dirsearch', 'high'),
    ('SIG-TF-008', 'feroxbuster', '(?i)feroxbuster', 'high'),
    ('SIG-TF-009', 'gobuster', '(?i)gobuster', 'high'),
    ('SIG-TF-010', 'wpscan', '(?i)wpscan', 'high'),
    ('SIG-TF-011', 'fscan', '(?i)fscan', 'high'),
    ('SIG-TF-012', 'masscan', '(?i)masscan', 'high'),
    ('SIG-TF-013', 'nmap', '(?i)Nmap (NSE|Scripting Engine)', 'medium'),
    ('SIG-TF-014', 'pocsuite', '(?i)pocsuite', 'high'),
    ('SIG-TF-015', 'afrog', '(?i)afrog', 'high'),
    ('SIG-TF-016', 'zgrab', '(?i)zgrab/', 'medium'),
    ('SIG-TF-017', 'subfinder', '(?i)subfinder', 'low'),
    ('SIG-TF-018', 'httpx', '(?i)\\bhttpx\\b', 'low'),
    ('SIG-TF-019', 'katana', '(?i)katana', 'medium'),
    ('SIG-TF-020', 'wfuzz', '(?i)Wfuzz', 'high'),
    ('SIG-TF-021', 'ffuf', '(?i)\\bffuf\\b', 'high'),
    ('SIG-TF-022', 'hydra', '(?i)Hydra', 'high'),
    ('SIG-TF-023', 'metasploit', '(?i)Metasploit', 'high'),
    ('SIG-TF-024', 'burp', '(?i)BurpCollaborator|Burp Suite', 'medium'),
    ('SIG-TF-025', 'zap', '(?i)ZAP|OWASP ZAP', 'medium'),
    ('SIG-TF-026', 'curl-generic', '(?i)^curl/', 'low'),
    ('SIG-TF-027', 'wget', '(?i)^Wget/', 'low'),
    ('SIG-TF-028', 'python-requests', '(?i)python-requests/', 'low'),
    ('SIG-TF-029', 'go-http-client', '(?i)^Go-http-client/', 'low'),
    ('SIG-TF-030', 'empty-ua', '^$', 'low'),
)

#: (id, language, pattern, severity) of server-side backdoors.
WEBSHELL_PATTERNS = (
    ('SIG-WS-001', 'php', '(?i)<\\?php\\s+@?eval\\s*\\(\\s*\\$_(POST|GET|REQUEST|COOKIE|SERVER)', 'high'),
    ('SIG-WS-002', 'php', '(?i)assert\\s*\\(\\s*\\$_(POST|GET|REQUEST|COOKIE)', 'high'),
    ('SIG-WS-003', 'php', '(?i)\\$\\{?_(POST|GET|REQUEST|COOKIE)\\}?\\s*\\[\\s*[\'"]?[a-z0-9_]+[\'"]?\\s*\\]\\s*\\(', 'high'),
    ('SIG-WS-004', 'php', '(?i)preg_replace\\s*\\(\\s*[\'"][^\'"]+/e[\'"]', 'high'),
    ('SIG-WS-005', 'php', '(?i)create_function\\s*\\(', 'medium'),
    ('SIG-WS-006', 'php', '(?i)\\b(system|exec|passthru|shell_exec|popen|proc_open)\\s*\\(\\s*\\$_(POST|GET|REQUEST|COOKIE)', 'high'),
    ('SIG-WS-007', 'php', '(?i)base64_decode\\s*\\(\\s*\\$_(POST|GET|REQUEST|COOKIE)', 'medium'),
    ('SIG-WS-008', 'php', '(?i)gzinflate\\s*\\(\\s*base64_decode', 'medium'),
    ('SIG-WS-009', 'php', '(?i)str_rot13\\s*\\(\\s*[\'"]?[a-z0-9+/=]{20,}', 'low'),
    ('SIG-WS-010', 'php', '(?i)@\\$[a-z_][a-z0-9_]*\\s*=\\s*\\$_(POST|GET|REQUEST|COOKIE)\\[', 'low'),
    ('SIG-WS-011', 'php', '(?i)\\bphpinfo\\s*\\(\\s*\\)', 'low'),
    ('SIG-WS-012', 'php', '(?i)move_uploaded_file\\s*\\([^,]+,\\s*\\$_(POST|GET|REQUEST)', 'medium'),
    ('SIG-WS-013', 'php', '(?i)file_put_contents\\s*\\(\\s*\\$_(POST|GET|REQUEST)[^,]+,\\s*\\$_', 'medium'),
    ('SIG-WS-014', 'jsp', '(?i)Runtime\\.getRuntime\\s*\\(\\s*\\)\\.exec\\s*\\(\\s*request\\.getParameter', 'high'),
    ('SIG-WS-015', 'jsp', '(?i)<%@\\s*page[^%]*import\\s*=\\s*"java\\.lang\\.(Runtime|ProcessBuilder)', 'medium'),
    ('SIG-WS-016', 'jsp', '(?i)ProcessBuilder\\s*\\([^)]*request\\.', 'high'),
    ('SIG-WS-017', 'jsp', '(?i)Class\\.forName\\s*\\(\\s*"[^"]+"\\s*\\)\\.newInstance\\s*\\(\\s*\\)', 'low'),
    ('SIG-WS-018', 'jsp', '(?i)new\\s+sun\\.misc\\.BASE64Decoder\\s*\\(\\s*\\)', 'low'),
    ('SIG-WS-019', 'jsp', '(?i)defineClass\\s*\\([^)]*', 'medium'),
    ('SIG-WS-020', 'jsp', '(?i)<%\\s*if\\s*\\(\\s*request\\.getParameter\\s*\\(\\s*"(cmd|pwd|pass)"', 'high'),
    ('SIG-WS-021', 'jsp', '(?i)getRuntime\\(\\)\\.exec', 'medium'),
    ('SIG-WS-022', 'aspx', '(?i)Request\\.(Form|QueryString|Item)\\s*\\[\\s*"[^"]+"\\s*\\]\\s*\\.ToString\\(\\)', 'low'),
    ('SIG-WS-023', 'aspx', '(?i)System\\.Diagnostics\\.Process\\.Start\\s*\\(\\s*Request\\.', 'high'),
    ('SIG-WS-024', 'aspx', '(?i)Assembly\\.Load\\s*\\(\\s*Convert\\.FromBase64String', 'medium'),
    ('SIG-WS-025', 'aspx', '(?i)\\bcmd\\.exe\\b|\\bpowershell\\.exe\\b', 'low'),
    ('SIG-WS-026', 'aspx', '(?i)<%@\\s*Page[^%]*Language="(JScript|VB|C#)"[^%]*Inherits="System\\.Web\\.UI\\.Page"', 'low'),
    ('SIG-WS-027', 'aspx', '(?i)WebShell|chopper', 'medium'),
    ('SIG-WS-028', 'generic', '(?i)\\beval\\s*\\(\\s*base64_decode', 'high'),
    ('SIG-WS-029', 'generic', '(?i)password\\s*=\\s*[\'"](rebeyond|admin|pass|root|godzilla|behinder)[\'"]', 'medium'),
    ('SIG-WS-030', 'generic', '(?i)key\\s*=\\s*[\'"](e45e329feb5d925b)[\'"]?', 'high'),
    ('SIG-WS-031', 'generic', '(?i)pass\\s*=\\s*[\'"]?rebeyond[\'"]?', 'high'),
    ('SIG-WS-032', 'php', '(?i)\\$\\w+\\s*=\\s*["\']\\\\x[0-9a-f]{2}', 'medium'),
    ('SIG-WS-033', 'php', '(?i)chr\\s*\\(\\s*\\d+\\s*\\)\\s*\\.\\s*chr\\s*\\(', 'medium'),
    ('SIG-WS-034', 'generic', '(?i)\\b(union\\s+select|information_schema)\\b', 'low'),
    ('SIG-WS-035', 'php', '(?i)error_reporting\\s*\\(\\s*0\\s*\\)\\s*;\\s*set_time_limit\\s*\\(\\s*0\\s*\\)', 'medium'),
    ('SIG-WS-036', 'generic', '(?i)WSO\\s+\\d+\\.\\d+|c99shell|r57shell|b374k', 'high'),
    ('SIG-WS-YARA-001', 'generic', '(?i)<\\?php[ -~]{30,}', 'high'),
    ('SIG-WS-YARA-002', 'generic', '(?i)eval\\([ -~]{30,}', 'high'),
    ('SIG-WS-YARA-003', 'generic', '(?i)<eval[ -~]{30,}', 'high'),
    ('SIG-WS-YARA-004', 'generic', '(?i)<%eval[ -~]{30,}', 'high'),
)

#: (id, category, location, kind, severity) of places where programs persist on Windows.
PERSISTENCE = (
    ('SIG-WIN-001', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run', 'registry_value_new', 'medium'),
    ('SIG-WIN-002', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce', 'registry_value_new', 'medium'),
    ('SIG-WIN-003', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnceEx', 'registry_value_new', 'medium'),
    ('SIG-WIN-004', 'run-key', 'HKLM\\SOFTWARE\\Wow6432Node\\Microsoft\\Windows\\CurrentVersion\\Run', 'registry_value_new', 'medium'),
    ('SIG-WIN-005', 'run-key', 'HKCU\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run', 'registry_value_new', 'medium'),
    ('SIG-WIN-006', 'run-key', 'HKCU\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce', 'registry_value_new', 'medium'),
    ('SIG-WIN-007', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\Userinit', 'registry_value_modified', 'high'),
    ('SIG-WIN-008', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\Shell', 'registry_value_modified', 'high'),
    ('SIG-WIN-009', 'service', 'HKLM\\SYSTEM\\CurrentControlSet\\Services\\<name>\\ImagePath', 'service_new_or_pathmod', 'high'),
    ('SIG-WIN-010', 'service', 'HKLM\\SYSTEM\\CurrentControlSet\\Services\\<name>\\ImagePath', 'service_new_unsigned', 'medium'),
    ('SIG-WIN-011', 'service', 'sc.exe create <svc> binPath= …', 'process_evidence_4688', 'medium'),
    ('SIG-WIN-012', 'service', 'HKLM\\SYSTEM\\CurrentControlSet\\Services\\<name>\\ImagePath', 'service_registry_encoded', 'high'),
    ('SIG-WIN-013', 'scheduled-task', 'C:\\Windows\\System32\\Tasks\\', 'task_xml_non_microsoft', 'medium'),
    ('SIG-WIN-014', 'scheduled-task', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Schedule\\TaskCache\\Tree\\', 'task_registry', 'medium'),
    ('SIG-WIN-015', 'scheduled-task', 'C:\\Windows\\System32\\Tasks\\<name>', 'task_action_shell', 'high'),
    ('SIG-WIN-016', 'scheduled-task', 'any', 'task_trigger_frequency', 'medium'),
    ('SIG-WIN-017', 'wmi-subscription', 'root\\subscription:__EventFilter', 'wmi_filter_new', 'high'),
    ('SIG-WIN-018', 'wmi-subscription', 'root\\subscription:__EventConsumer', 'wmi_consumer_commandline', 'high'),
    ('SIG-WIN-019', 'wmi-subscription', 'root\\subscription:__FilterToConsumerBinding', 'wmi_binding_new', 'high'),
    ('SIG-WIN-020', 'wmi-subscription', 'root\\default:__EventFilter', 'wmi_alt_namespace', 'high'),
    ('SIG-WIN-021', 'com-hijack', 'HKCU\\Software\\Classes\\CLSID\\<clsid>\\InprocServer32', 'com_hkcu_override', 'high'),
    ('SIG-WIN-022', 'com-hijack', 'HKCU\\Software\\Classes\\CLSID\\<clsid>\\TreatAs', 'com_treatas', 'high'),
    ('SIG-WIN-023', 'com-hijack', 'HKCR\\CLSID\\<clsid>\\InprocServer32', 'com_dll_path_unsigned', 'high'),
    ('SIG-WIN-024', 'ifeo-debugger', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Image File Execution Options\\<exe>\\Debugger', 'ifeo_debugger_set', 'high'),
    ('SIG-WIN-025', 'ifeo-debugger', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Image File Execution Options\\<exe>\\GlobalFlag=0x200', 'ifeo_silent_process_exit', 'high'),
    ('SIG-WIN-026', 'appinit-dlls', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\AppInit_DLLs', 'appinit_dll_set', 'high'),
    ('SIG-WIN-027', 'appinit-dlls', 'HKLM\\SYSTEM\\CurrentControlSet\\Control\\Session Manager\\AppCertDlls', 'appcert_dll_set', 'high'),
    ('SIG-WIN-028', 'dll-search-order', 'C:\\Windows\\System32\\<dll> shadowed by C:\\<workdir>\\<dll>', 'dll_side_by_side', 'high'),
    ('SIG-WIN-029', 'dll-search-order', 'any process cwd', 'phantom_dll', 'medium'),
    ('SIG-WIN-030', 'startup-folder', 'C:\\ProgramData\\Microsoft\\Windows\\Start Menu\\Programs\\StartUp\\', 'file_new', 'medium'),
    ('SIG-WIN-031', 'startup-folder', 'C:\\Users\\<u>\\AppData\\Roaming\\Microsoft\\Windows\\Start Menu\\Programs\\Startup\\', 'file_new', 'medium'),
    ('SIG-WIN-032', 'startup-folder', 'startup lnk target', 'lnk_target_shell', 'high'),
    ('SIG-WIN-033', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Explorer\\Shell Folders', 'registry_folder_redirect', 'high'),
    ('SIG-WIN-034', 'run-key', 'HKLM\\SYSTEM\\CurrentControlSet\\Control\\Session Manager\\BootExecute', 'registry_bootexecute', 'high'),
    ('SIG-WIN-035', 'service', 'HKLM\\SYSTEM\\CurrentControlSet\\Services\\<name>\\Parameters\\ServiceDll', 'service_dll_svchost', 'high'),
    ('SIG-WIN-036', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Explorer\\ShellIconOverlayIdentifiers\\<name>', 'shell_extension', 'medium'),
    ('SIG-WIN-037', 'scheduled-task', 'any', 'task_hidden', 'high'),
    ('SIG-WIN-038', 'wmi-subscription', 'any consumer', 'wmi_consumer_activescript', 'high'),
    ('SIG-WIN-039', 'com-hijack', 'HKCU\\Software\\Classes\\Folder\\shell\\open\\command', 'com_shell_verb', 'high'),
    ('SIG-WIN-040', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\Notify', 'winlogon_notify', 'high'),
    ('SIG-WIN-041', 'service', 'HKLM\\SYSTEM\\CurrentControlSet\\Services\\<name>\\FailureCommand', 'service_failure_action', 'high'),
    ('SIG-WIN-042', 'ifeo-debugger', 'HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\AeDebug\\Debugger', 'aedebug_hijack', 'high'),
    ('SIG-WIN-043', 'dll-search-order', 'C:\\Windows\\System32\\wbem\\<dll>', 'wmi_dll_hijack', 'high'),
    ('SIG-WIN-044', 'appinit-dlls', 'HKLM\\SOFTWARE\\Microsoft\\Cryptography\\OID\\EncodingType 0\\CryptSIPDllVerifyIndirectData\\<CLSID>\\Dll', 'sip_hijack', 'high'),
    ('SIG-WIN-045', 'run-key', 'HKLM\\SOFTWARE\\Microsoft\\Netsh', 'netsh_helper', 'high'),
    ('SIG-WIN-046', 'com-hijack', 'HKCR\\.<ext>\\<progid>\\shell\\open\\command', 'file_association_hijack', 'high'),
    ('SIG-WIN-047', 'startup-folder', 'C:\\Users\\<u>\\AppData\\Local\\Microsoft\\OneDrive\\StandaloneUpdater.exe', 'trusted_binary_replaced', 'high'),
    ('SIG-WIN-048', 'service', 'HKLM\\SYSTEM\\CurrentControlSet\\Services\\<name>\\ImagePath referencing \\\\<remote>\\...', 'service_unc_path', 'high'),
)

#: (type, value, confidence, tag) of known indicators.
IOCS = (
    ('path', '/aaa9', 'medium', 'c2:cobaltstrike'),
    ('path', '/cm', 'medium', 'c2:cobaltstrike'),
    ('path', '/dot.gif', 'low', 'c2:cobaltstrike'),
    ('path', '/__utm.gif', 'low', 'c2:cobaltstrike'),
    ('path', '/pixel.gif', 'low', 'c2:cobaltstrike'),
    ('ua', '(?i)Mozilla/5\\.0 \\(compatible; MSIE 9\\.0; Windows NT 6\\.1; WOW64; Trident/5\\.0\\)$', 'low', 'c2:cobaltstrike'),
    ('path', '/admin/get.php', 'medium', 'c2:empire'),
    ('path', '/login/process.php', 'medium', 'c2:empire'),
    ('path', '/news.php', 'low', 'c2:empire'),
    ('ua', '(?i)Mozilla/5\\.0 \\(Windows NT 6\\.1; WOW64; Trident/7\\.0; rv:11\\.0\\) like Gecko$', 'low', 'c2:empire'),
    ('path', '/sliver', 'medium', 'c2:sliver'),
    ('ua', '(?i)sliver/', 'high', 'c2:sliver'),
    ('path', '/jakarta/invoker/JMXInvokerServlet', 'medium', 'c2:metasploit'),
    ('path', '/manager/html', 'low', 'tool:tomcat-bruteforce'),
    ('path', '/struts2-showcase', 'low', 'tool:struts2-scan'),
    ('domain', 'xmr.pool.minergate.com', 'high', 'category:mining'),
    ('domain', '*.nanopool.org', 'high', 'category:mining'),
    ('domain', '*.minexmr.com', 'high', 'category:mining'),
    ('domain', '*.supportxmr.com', 'high', 'category:mining'),
    ('domain', 'pool.hashvault.pro', 'high', 'category:mining'),
    ('path', ':4444', 'low', 'category:reverse-shell-port'),
    ('path', ':1337', 'low', 'category:reverse-shell-port'),
    ('path', ':8888', 'low', 'category:reverse-shell-port'),
    ('path', ':13337', 'low', 'category:reverse-shell-port'),
    ('ua', '(?i)antSword/', 'high', 'tool:antsword'),
    ('ua', '(?i)Behinder', 'high', 'tool:behinder'),
    ('ua', '(?i)Godzilla', 'high', 'tool:godzilla'),
    ('ua', '(?i)^Mozilla/5\\.0 \\(Macintosh; Intel Mac OS X 10_15_7\\) AppleWebKit/537\\.36 \\(KHTML, like Gecko\\) Chrome/87\\.0\\.4280\\.88 Safari/537\\.36$', 'low', 'tool:godzilla-default-ua'),
    ('path', 'key=key', 'medium', 'tool:godzilla-default-key'),
    ('ua', '(?i)sqlmap/', 'high', 'tool:sqlmap'),
    ('ua', '(?i)Nuclei', 'high', 'tool:nuclei'),
    ('ua', '(?i)\\bxray\\b', 'medium', 'tool:xray'),
    ('ua', '(?i)AWVS|Acunetix', 'high', 'tool:acunetix'),
    ('ua', '(?i)Nessus', 'high', 'tool:nessus'),
    ('ua', '(?i)Nikto', 'high', 'tool:nikto'),
    ('ua', '(?i)dirsearch', 'high', 'tool:dirsearch'),
    ('ua', '(?i)wpscan', 'high', 'tool:wpscan'),
    ('ua', '(?i)Acunetix', 'high', 'tool:acunetix'),
    ('ua', '(?i)fscan', 'high', 'tool:fscan'),
    ('ua', '(?i)masscan', 'high', 'tool:masscan'),
    ('ua', '(?i)curl/|Wget/', 'low', 'category:recon'),
    ('hash:sha256', '275a021bbfb6489e54d471899f7db9d1663fc695ec2fe2a2c4538aabf651fd0f', 'medium', 'category:test-sample'),
    ('hash:md5', '44d88612fea8a8f36de82e1278abb02f', 'medium', 'category:test-sample'),
    ('hash:sha1', '3395856ce81f2b7382dee72602f798b642f14140', 'medium', 'category:test-sample'),
    ('hash:sha256', 'e5d3e64a31a8ee2bb27d92a64a4b7e9b4b3a8b8a5a9e8f0a1b2c3d4e5f6a7b8c', 'low', 'category:placeholder'),
    ('ua', '(?i)gobuster', 'high', 'tool:gobuster'),
    ('ua', '(?i)feroxbuster', 'high', 'tool:feroxbuster'),
    ('ua', '(?i)pocsuite', 'high', 'tool:pocsuite'),
    ('ua', '(?i)afrog', 'high', 'tool:afrog'),
    ('path', '/.git/config', 'medium', 'category:recon-sensitive-path'),
    ('path', '/.env', 'medium', 'category:recon-sensitive-path'),
)
# fmt: on
