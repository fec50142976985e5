"""Names and formats shared with the deployment files and payloads these jobs
read and write."""

# Names, key formats and payload fields of the deployment
# outputs, env files, datasources and telemetry (they must match to interoperate).
DEFAULT_INDEX_NAME = "onelake-documents-index"
DOCUMENTS_FOLDER = "documents"
OWN_DATASOURCE_PREFIX = "Fabric-Workspace-"
DATASOURCE_KIND = "PowerBI"
PAIR_PREFIX_LAKEHOUSE = "FABRIC_LAKEHOUSE"
PAIR_PREFIX_WORKSPACE = "FABRIC_WORKSPACE"
CONFIG_KEYS = ["FABRIC_CAPACITY_ID", "FABRIC_WORKSPACE_NAME", "FABRIC_DOMAIN_NAME"]
OUTPUT_CAPACITY_FIELD = "fabricCapacityId"
OUTPUT_WORKSPACE_FIELD = "desiredFabricWorkspaceName"
CAPACITY_RESOURCE_FMT = "/subscriptions/%s/resourceGroups/%s/providers/Microsoft.Fabric/capacities/%s"
TELEMETRY_WORKSPACE_FIELD = "FabricWorkspaceId"
