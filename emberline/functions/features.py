"""Features of a process start, as one map column: indicators of the command line, binaries, roles, paths and shapes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns as C

#: Binaries by role; the first role that names one counts.
ROLES = {
    "office": "winword.exe excel.exe powerpnt.exe outlook.exe onenote.exe msaccess.exe mspub.exe visio.exe",
    "browser": "chrome.exe firefox.exe msedge.exe iexplore.exe opera.exe brave.exe microsoftedge.exe",
    "shell": "cmd.exe powershell.exe pwsh.exe powershell_ise.exe",
    "script_host": "wscript.exe cscript.exe mshta.exe",
    "lolbin": (
        "rundll32.exe regsvr32.exe msbuild.exe installutil.exe regasm.exe regsvcs.exe cmstp.exe msiexec.exe odbcconf.exe forfiles.exe pcalua.exe msdt.exe msxsl.exe hh.exe ieexec.exe "
        "infdefaultinstall.exe presentationhost.exe syncappvpublishingserver.exe control.exe atbroker.exe mavinject.exe verclsid.exe xwizard.exe wmic.exe certutil.exe bitsadmin.exe esentutl.exe "
        "expand.exe extrac32.exe makecab.exe replace.exe desktopimgdownldr.exe finger.exe csc.exe vbc.exe jsc.exe ftp.exe curl.exe scriptrunner.exe wsl.exe bash.exe cmdl32.exe diskshadow.exe "
        "dnscmd.exe mmc.exe createdump.exe sqldumper.exe rpcping.exe wuauclt.exe msconfig.exe ntdsutil.exe procdump.exe"
    ),
    "admin_tool": "schtasks.exe at.exe sc.exe reg.exe regedit.exe vssadmin.exe wbadmin.exe bcdedit.exe netsh.exe wevtutil.exe auditpol.exe taskkill.exe icacls.exe takeown.exe attrib.exe fsutil.exe cipher.exe psexec.exe psexesvc.exe",
    "discovery": "whoami.exe net.exe net1.exe nltest.exe ipconfig.exe systeminfo.exe quser.exe qwinsta.exe tasklist.exe netstat.exe arp.exe route.exe hostname.exe nslookup.exe dsquery.exe klist.exe cmdkey.exe adfind.exe",
    "service_host": "services.exe svchost.exe wmiprvse.exe taskeng.exe taskhost.exe taskhostw.exe dllhost.exe",
    "session": "explorer.exe userinit.exe winlogon.exe runtimebroker.exe sihost.exe",
    "server_app": "w3wp.exe php-cgi.exe httpd.exe nginx.exe sqlservr.exe tomcat.exe tomcat8.exe tomcat9.exe",
    "system_core": "smss.exe csrss.exe wininit.exe lsass.exe werfault.exe consent.exe",
}
#: Binaries of the roles above that do not come with Windows, beside those of office, browser and server_app.
NOT_WINDOWS = ("pwsh.exe", "psexec.exe", "psexesvc.exe", "adfind.exe", "procdump.exe", "sqldumper.exe", "curl.exe")
#: Fixed patterns: what command lines show, on lower case without carets.
INDICATORS = {
    "ps_encoded": r"(?:^|\s)[-/]e(?:nc(?:odedcommand)?|c)?\s+[a-z0-9+/=]{16,}",
    "ps_hidden_window": r"[-/]w(?:indowstyle)?\s+h(?:idden)?\b",
    "ps_exec_bypass": r"[-/](?:ex(?:ec(?:utionpolicy)?)?|ep)\s+(?:bypass|unrestricted)\b",
    "ps_noprofile": r"[-/]nop(?:rofile)?\b",
    "ps_noninteractive": r"[-/]noni(?:nteractive)?\b",
    "ps_iex": r"\b(?:iex|invoke-expression)\b",
    "download_cradle": r"downloadstring|downloadfile|downloaddata|net\.webclient|invoke-webrequest|\biwr\b|invoke-restmethod|\birm\b|start-bitstransfer|\bwget\b|\bcurl\b",
    "url": r"\b(?:https?|ftp)://",
    "ip_literal": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "unc_path": r"\\\\[a-z0-9._$-]+\\",
    "base64_blob": r"[a-z0-9+/]{40,}={0,2}",
    "frombase64": r"frombase64string",
    "reflective_load": r"reflection\.assembly|\[system\.reflection|assembly\]::load",
    "defender_tamper": r"set-mppreference|add-mppreference|disablerealtimemonitoring|amsiutils|amsiinitfailed",
    "scriptlet_remote": r"scrobj\.dll|/i:(?:https?|\\\\)",
    "script_protocol": r"\b(?:javascript|vbscript):",
    "rundll32_ordinal": r"rundll32(?:\.exe)?[\"']?\s+[^,]+,\s*#\d",
    "certutil_transfer": r"certutil(?:\.exe)?[\"']?\s.*[-/](?:urlcache|decode|encode|verifyctl)\b",
    "bitsadmin_transfer": r"bitsadmin(?:\.exe)?[\"']?\s.*/(?:transfer|addfile|setnotifycmdline)\b",
    "mshta_remote": r"mshta(?:\.exe)?[\"']?\s+[\"']?(?:https?|ftp)://",
    "msiexec_remote": r"msiexec(?:\.exe)?[\"']?\s.*/[iq]\S*\s+[\"']?https?://",
    "wmic_process_create": r"wmic.*process\s+call\s+create",
    "wmic_remote_node": r"wmic.*/node:",
    "schtasks_create": r"schtasks(?:\.exe)?[\"']?\s.*/create\b",
    "service_create": r"\bsc(?:\.exe)?[\"']?\s+(?:\\\\\S+\s+)?(?:create|config)\b.*binpath|new-service\b",
    "run_key_write": r"(?:reg(?:\.exe)?[\"']?\s+add|set-itemproperty|new-itemproperty).*\\currentversion\\run(?:once)?\b",
    "hive_dump": r"reg(?:\.exe)?[\"']?\s+save\s+hklm\\(?:sam|system|security)\b",
    "shadow_delete": r"vssadmin.*delete\s+shadows|shadowcopy\s+delete|wbadmin.*delete\s+catalog|recoveryenabled\s+no|bootstatuspolicy\s+ignoreallfailures",
    "log_clear": r"wevtutil(?:\.exe)?[\"']?\s+(?:cl|clear-log)\b|clear-eventlog|remove-eventlog",
    "firewall_change": r"netsh.*(?:advfirewall|firewall).*\b(?:add|set|delete|disable|off)\b|netsh.*portproxy",
    "account_add": r"\bnet1?(?:\.exe)?[\"']?\s+(?:user|localgroup|group)\b.*/add\b|new-localuser|add-localgroupmember",
    "discovery_command": r"\bwhoami\b|\bnet1?(?:\.exe)?[\"']?\s+(?:user|group|localgroup|view|share|session|accounts)\b|\bnltest\b|\bsysteminfo\b|ipconfig\s+/all|\bquser\b|query\s+user|\barp\s+-a\b|\bdsquery\b|\badfind\b|get-ad(?:user|computer|group)\b",
    "lsass_access": r"\blsass\b|minidump",
    "credential_tooling": r"mimikatz|sekurlsa|lsadump|kerberos::|rubeus|kerberoast|ntds\.dit",
    "remote_exec": r"\bpsexec|\\admin\$|\\c\$|\bwinrs\b|invoke-command\s.*-computername|enter-pssession|new-pssession",
    "wmi_dcom_exec": r"invoke-wmimethod|win32_process|mmc20\.application|shellwindows|shellbrowserwindow",
    "script_from_user_dir": r"(?:\\temp\\|\\appdata\\|\\users\\public\\|\\programdata\\|\\downloads\\)[^\s\"']*\.(?:ps1|vbs|vbe|js|jse|hta|bat|cmd|dll|scr|wsf)\b",
    "archive_staging": r"compress-archive|\b7za?(?:\.exe)?[\"']?\s+a\b|\brar(?:\.exe)?[\"']?\s+a\b",
    "hide_attrib": r"\battrib(?:\.exe)?[\"']?\s.*\+[hs]\b",
    "acl_takeover": r"icacls.*/grant\s+(?:everyone|\*s-1-1-0)|takeown(?:\.exe)?[\"']?\s+/f\b",
    "uac_bypass": r"\\ms-settings\\shell\\open\\command|\\mscfile\\shell\\open\\command|\bfodhelper\b|\bcomputerdefaults\b|\bsdclt\b.*/kickoffelev",
    "string_obfuscation": r"\[char\]\s*\d|-join\s*\(|-bxor\b|-f\s*[\"']\{\d\}",
    "command_chaining": r"&&|\|\||\s&\s|\s\|\s",
}
DOUBLE_EXTENSION = r"\.(?:pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|txt|rtf|zip)\.(?:exe|scr|com|bat|cmd|pif|js|vbs|hta)$"


def role(name: Column) -> Column:
    """The role of a binary; other for an unknown one, missing without a name."""
    out = F.when(F.coalesce(name, F.lit("")) == "", "missing")
    for r, members in ROLES.items():
        out = out.when(name.isin(*members.split()), r)
    return out.otherwise("other")


def names() -> list[str]:
    """All features in their order."""
    roles = [*ROLES, "other", "missing"]
    binaries = list(dict.fromkeys(b for m in ROLES.values() for b in m.split()))
    shapes = ["cmd_length", "cmd_token_count", "cmd_entropy", "cmd_quote_count", "cmd_special_char_ratio", "name_length", "name_entropy", "name_digit_ratio", "path_depth"]
    return [
        *("cmd_missing", "name_missing", "parent_missing", "cmd_obfuscated", "cmd_evasion_count"),
        *(f"ind_{n}" for n in INDICATORS),
        *("path_masquerade", "name_double_extension", "name_not_exe", "name_equals_parent"),
        *(f"path_class={c}" for c in ("system", "program_files", "user_writable", "temp", "other", "unknown", "none")),
        *shapes,
        *(f"bin={b}" for b in (*binaries, "other")),
        *(f"parent_bin={b}" for b in (*binaries, "other", "missing")),
        *(f"role={r}" for r in roles),
        *(f"parent_role={r}" for r in roles),
        *(f"pair={p}>{c}" for p in roles for c in roles),
    ]


def with_features(df: DataFrame, command: Column, executable: Column, name: Column, parent: Column, column: str = "features") -> DataFrame:
    """Adds a map of feature to value, without zeros; what is missing sets marks of its own.

    What many features share is worked out once, in projections of its own, which keeps the generated code small.
    """
    binary, above = F.lower(F.coalesce(F.nullif(C.basename(name), F.lit("")), C.basename(executable))), F.lower(C.basename(parent))
    first = df.withColumns({"_command": command, "_name": binary, "_parent": above, "_executable": executable})
    own = {
        "_shown": F.lower(F.replace(F.col("_command"), F.lit("^"))),
        "_text": C.normalized_text(F.col("_command")),
        "_techniques": F.size(C.evasion_techniques(F.col("_command"))),
        "_where": F.coalesce(C.path_class(F.col("_executable")), F.lit("none")),
        "_stem": F.regexp_replace("_name", r"\.[^.]*$", ""),
        "_role": role(F.col("_name")),
        "_above": role(F.col("_parent")),
    }
    return first.withColumns(own).withColumn(column, _features()).drop("_command", "_name", "_parent", "_executable", *own)


def _features() -> Column:
    command, executable, name, parent, shown, text, techniques, where, stem, known, known_parent = (F.col(c) for c in ("_command", "_executable", "_name", "_parent", "_shown", "_text", "_techniques", "_where", "_stem", "_role", "_above"))
    there, named = command.isNotNull(), F.coalesce(name, F.lit("")) != ""
    windows = [b for r, m in ROLES.items() if r not in ("office", "browser", "server_app") for b in m.split() if b not in NOT_WINDOWS]
    rate = lambda part, whole: F.when(F.length(whole) > 0, F.round(F.length(part) / F.length(whole), 6)).otherwise(0.0)

    def when(mark: Column | str, condition: Column, value: Column | None = None) -> Column:
        key = F.lit(mark) if isinstance(mark, str) else mark
        return F.struct(key.alias("key"), F.when(condition, F.lit(1.0) if value is None else F.round(value.cast("double"), 6)).otherwise(0.0).alias("value"))

    entries = [
        when("cmd_missing", ~there),
        when("name_missing", ~named),
        when("parent_missing", known_parent == "missing"),
        when("cmd_obfuscated", there & (techniques > 0)),
        when("cmd_evasion_count", there, techniques),
        *[when(f"ind_{n}", there & shown.rlike(p)) for n, p in INDICATORS.items()],
        when("path_masquerade", named & name.isin(*windows) & ~where.isin("system", "none", "unknown")),
        when("name_double_extension", named & name.rlike(DOUBLE_EXTENSION)),
        when("name_not_exe", named & ~F.endswith(name, F.lit(".exe"))),
        when("name_equals_parent", named & (name == parent)),
        when(F.concat(F.lit("path_class="), where), F.lit(True)),
        when("cmd_length", there, F.log1p(F.length(text))),
        when("cmd_token_count", there, F.log1p(F.size(F.regexp_extract_all(text, F.lit(r"([a-z0-9_.$<>-]+)"), F.lit(1))))),
        when("cmd_entropy", there, F.round(C.entropy(text), 3)),
        when("cmd_quote_count", there, F.length(F.regexp_replace(text, "[^\"']", ""))),
        when("cmd_special_char_ratio", there, rate(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", ""), text)),
        when("name_length", named, F.length(stem)),
        when("name_entropy", named, F.round(C.entropy(stem), 3)),
        when("name_digit_ratio", named, rate(F.regexp_replace(stem, r"\D", ""), stem)),
        when("path_depth", F.coalesce(executable, F.lit("")) != "", F.length(F.regexp_replace(C.normalized_text(executable), r"[^\\]", ""))),
        when(F.concat(F.lit("bin="), F.when(known.isin("other", "missing"), "other").otherwise(name)), F.lit(True)),
        when(F.concat(F.lit("parent_bin="), F.when(known_parent.isin("other", "missing"), known_parent).otherwise(parent)), F.lit(True)),
        when(F.concat(F.lit("role="), known), F.lit(True)),
        when(F.concat(F.lit("parent_role="), known_parent), F.lit(True)),
        when(F.concat(F.lit("pair="), known_parent, F.lit(">"), known), F.lit(True)),
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] != 0))
