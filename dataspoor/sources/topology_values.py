"""Fixed values of the topology catalogue: how deployables, stores and clients are known, and proposed purposes.

Rows are (section, entry, language, key, values), several values with " | " between.
"""

from __future__ import annotations

# Fixed values.
TOPOLOGY = (
    ("deployables", "cs.web", "csharp", "kind", "service"),
    ("deployables", "cs.web", "csharp", "project.sdk", "Microsoft.NET.Sdk.Web | Microsoft.NET.Sdk.BlazorWebAssembly"),
    ("deployables", "cs.worker", "csharp", "kind", "worker"),
    ("deployables", "cs.worker", "csharp", "project.sdk", "Microsoft.NET.Sdk.Worker"),
    ("deployables", "cs.exe", "csharp", "kind", "application"),
    ("deployables", "cs.exe", "csharp", "project.output_type", "Exe | WinExe"),
    ("deployables", "cs.functions", "csharp", "kind", "function"),
    ("deployables", "cs.functions", "csharp", "project.package_refs", "Microsoft.Azure.Functions.Worker"),
    ("deployables", "js.server", "javascript", "kind", "service"),
    ("deployables", "js.server", "javascript", "package.framework_dependency", "True"),
    ("deployables", "js.app", "javascript", "kind", "web_client"),
    ("deployables", "js.app", "javascript", "package.dependencies", "next | nuxt | vite | react-scripts | @angular/core | @remix-run/node | @sveltejs/kit | astro | gatsby"),
    ("deployables", "js.start-script", "javascript", "kind", "service"),
    ("deployables", "js.start-script", "javascript", "package.scripts", "start"),
    ("deployables", "py.django", "python", "kind", "service"),
    ("deployables", "py.django", "python", "marker_files", "manage.py"),
    ("deployables", "py.app", "python", "kind", "service"),
    ("deployables", "py.app", "python", "module_values", "fastapi.FastAPI() | flask.Flask() | starlette.applications.Starlette() | celery.Celery() | litestar.Litestar() | aiohttp.web.Application()"),
    ("deployables", "py.app", "python", "root_markers", "pyproject.toml | setup.py | setup.cfg | requirements.txt | Dockerfile"),
    ("deployables", "any.dockerfile", None, "kind", "service"),
    ("deployables", "any.dockerfile", None, "marker_files", "Dockerfile"),
    ("never", "cs.aspire-host", None, "project.sdk", "Aspire.AppHost.Sdk"),
    ("never", "cs.aspire-host-property", None, "project.properties.IsAspireHost", "true"),
    ("never", "cs.test-project", None, "project.properties.IsTestProject", "true"),
    ("never", "cs.test-sdk", None, "project.package_refs", "Microsoft.NET.Test.Sdk"),
    ("never", "cs.mstest-sdk", None, "project.sdk", "MSTest.Sdk"),
    ("never", "cs.test-frameworks", None, "project.package_refs", "xunit | xunit.v3 | NUnit | MSTest.TestFramework | TUnit"),
    ("orchestrators", "cs.aspire.project", "csharp", "calls", "**.{AddProject,AddDotnetProject,AddCSharpApp}"),
    ("orchestrators", "cs.aspire.project", "csharp", "name_arg", "0"),
    ("orchestrators", "cs.aspire.project", "csharp", "path_arg", "1"),
    ("orchestrators", "cs.aspire.project", "csharp", "type_arg_namespace", "Projects"),
    ("orchestrators", "cs.aspire.executable", "csharp", "calls", "**.{AddNpmApp,AddNodeApp,AddViteApp,AddJavaScriptApp,AddPythonApp,AddUvicornApp,AddDockerfile}"),
    ("orchestrators", "cs.aspire.executable", "csharp", "name_arg", "0"),
    ("orchestrators", "cs.aspire.executable", "csharp", "path_arg", "1"),
    ("stores", "cs.efcore", "csharp", "kind", "entity_framework"),
    ("stores", "cs.efcore", "csharp", "contexts", "Microsoft.EntityFrameworkCore.DbContext | Microsoft.AspNetCore.Identity.EntityFrameworkCore.{IdentityDbContext,IdentityUserContext}"),
    ("stores", "cs.efcore", "csharp", "sets", "**.DbSet"),
    ("stores", "cs.efcore", "csharp", "configurations", "**.IEntityTypeConfiguration"),
    ("stores", "cs.efcore", "csharp", "not_mapped", "**.NotMappedAttribute{,()}"),
    ("stores", "cs.efcore", "csharp", "table_attributes", "**.TableAttribute{,()}"),
    ("stores", "cs.efcore", "csharp", "column_attributes", "**.ColumnAttribute{,()}"),
    ("stores", "cs.efcore", "csharp", "owned_attributes", "**.OwnedAttribute{,()}"),
    ("stores", "cs.efcore", "csharp", "model_method", "OnModelCreating"),
    ("stores", "cs.efcore", "csharp", "fluent.entity", "Entity"),
    ("stores", "cs.efcore", "csharp", "fluent.table", "ToTable"),
    ("stores", "cs.efcore", "csharp", "fluent.column", "HasColumnName"),
    ("stores", "cs.efcore", "csharp", "fluent.property", "Property"),
    ("stores", "cs.efcore", "csharp", "fluent.ignore", "Ignore"),
    ("stores", "cs.efcore", "csharp", "fluent.owned", "OwnsOne | OwnsMany"),
    ("stores", "cs.efcore", "csharp", "fluent.schema", "HasDefaultSchema"),
    ("stores", "cs.efcore", "csharp", "fluent.apply", "ApplyConfiguration"),
    ("stores", "cs.efcore", "csharp", "fluent.apply_all", "ApplyConfigurationsFromAssembly"),
    ("stores", "cs.efcore", "csharp", "registrations", "**.{AddDbContext,AddDbContextPool,AddDbContextFactory,AddPooledDbContextFactory} | **.{AddNpgsqlDbContext,AddSqlServerDbContext,AddMySqlDbContext,AddSqliteDbContext,AddCosmosDbContext,AddOracleDatabaseDbContext}"),
    ("stores", "cs.efcore", "csharp", "database_calls", "**.GetConnectionString"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.context", "Microsoft.AspNetCore.Identity.EntityFrameworkCore.{IdentityDbContext,IdentityUserContext}"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.0.name", "AspNetUsers"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.0.entity_type_arg", "0"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.0.fields", "Id | UserName | NormalizedUserName | Email | NormalizedEmail | EmailConfirmed | PasswordHash | SecurityStamp | ConcurrencyStamp | PhoneNumber | PhoneNumberConfirmed | TwoFactorEnabled | LockoutEnd | LockoutEnabled | AccessFailedCount"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.1.name", "AspNetUserClaims"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.1.fields", "Id | UserId | ClaimType | ClaimValue"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.2.name", "AspNetUserLogins"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.2.fields", "LoginProvider | ProviderKey | ProviderDisplayName | UserId"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.3.name", "AspNetUserTokens"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.3.fields", "UserId | LoginProvider | Name | Value"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.4.name", "AspNetRoles"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.4.fields", "Id | Name | NormalizedName | ConcurrencyStamp"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.5.name", "AspNetUserRoles"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.5.fields", "UserId | RoleId"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.6.name", "AspNetRoleClaims"),
    ("stores", "cs.efcore", "csharp", "base_collections.0.collections.6.fields", "Id | RoleId | ClaimType | ClaimValue"),
    ("stores", "py.django", "python", "kind", "django"),
    ("stores", "py.django", "python", "models", "django.db.models.Model | django.db.models.base.Model | django.contrib.auth.models.{AbstractUser,AbstractBaseUser,User} | django.contrib.auth.base_user.AbstractBaseUser"),
    ("stores", "py.django", "python", "meta_class", "Meta"),
    ("stores", "py.django", "python", "columns", "django.db.models.*Field() | django.db.models.fields.*Field() | django.contrib.postgres.fields.*Field()"),
    ("stores", "py.django", "python", "not_columns", "django.db.models.ManyToManyField()"),
    ("stores", "py.django", "python", "relations", "django.db.models.{ForeignKey,OneToOneField}()"),
    ("stores", "py.django", "python", "column_keyword", "db_column"),
    ("stores", "py.django", "python", "inherited.0.base", "django.contrib.auth.models.{AbstractUser,User}"),
    ("stores", "py.django", "python", "inherited.0.fields", "password | last_login | is_superuser | username | first_name | last_name | email | is_staff | is_active | date_joined"),
    ("stores", "py.django", "python", "inherited.1.base", "django.contrib.auth.{models,base_user}.AbstractBaseUser"),
    ("stores", "py.django", "python", "inherited.1.fields", "password | last_login"),
    ("stores", "py.sqlalchemy", "python", "kind", "sqlalchemy"),
    ("stores", "py.sqlalchemy", "python", "models", "sqlalchemy.orm.DeclarativeBase | sqlalchemy.orm.decl_api.DeclarativeBase | sqlalchemy.orm.{declarative_base,decl_api.declarative_base}() | sqlalchemy.ext.declarative.declarative_base() | flask_sqlalchemy.SQLAlchemy().Model"),
    ("stores", "py.sqlalchemy", "python", "table_member", "__tablename__"),
    ("stores", "py.sqlalchemy", "python", "abstract_member", "__abstract__"),
    ("stores", "py.sqlalchemy", "python", "columns", "sqlalchemy.{Column,schema.Column}() | sqlalchemy.orm.mapped_column() | flask_sqlalchemy.SQLAlchemy().Column()"),
    ("stores", "py.sqlalchemy", "python", "column_arg", "0"),
    ("stores", "py.sqlalchemy", "python", "column_keyword", "name"),
    ("stores", "py.sqlalchemy", "python", "annotation_columns", "Mapped["),
    ("stores", "js.prisma", "javascript", "kind", "prisma"),
    ("stores", "js.prisma", "javascript", "files", "**/*.prisma"),
    ("stores", "js.prisma", "javascript", "used_by_imports", "@prisma/client"),
    ("clients", "cs.httpclient.typed", "csharp", "calls", "**.AddHttpClient"),
    ("clients", "cs.httpclient.typed", "csharp", "client", "type_arg"),
    ("clients", "cs.httpclient.typed", "csharp", "injects", "System.Net.Http.HttpClient"),
    ("clients", "cs.httpclient.typed", "csharp", "configure.lambda_fields", "BaseAddress"),
    ("clients", "cs.httpclient.typed", "csharp", "chained", "**.ConfigureHttpClient"),
    ("clients", "cs.httpclient.typed", "csharp", "wrappers", "System.Uri{,()}"),
    ("clients", "cs.httpclient.named", "csharp", "calls", "**.AddHttpClient"),
    ("clients", "cs.httpclient.named", "csharp", "client", "named"),
    ("clients", "cs.httpclient.named", "csharp", "name_arg", "0"),
    ("clients", "cs.httpclient.named", "csharp", "creates", "System.Net.Http.IHttpClientFactory.CreateClient"),
    ("clients", "cs.httpclient.named", "csharp", "configure.lambda_fields", "BaseAddress"),
    ("clients", "cs.httpclient.named", "csharp", "chained", "**.ConfigureHttpClient"),
    ("clients", "cs.httpclient.named", "csharp", "wrappers", "System.Uri{,()}"),
    ("clients", "js.axios.create", "javascript", "calls", "axios:create | axios:default.create"),
    ("clients", "js.axios.create", "javascript", "client", "result"),
    ("clients", "js.axios.create", "javascript", "configure.arg", "0"),
    ("clients", "js.axios.create", "javascript", "configure.fields", "baseURL"),
    ("clients", "js.ky.create", "javascript", "calls", "ky:create | ky:default.create | ky:extend | ky:default.extend"),
    ("clients", "js.ky.create", "javascript", "client", "result"),
    ("clients", "js.ky.create", "javascript", "configure.arg", "0"),
    ("clients", "js.ky.create", "javascript", "configure.fields", "prefixUrl"),
    ("clients", "py.httpx.client", "python", "calls", "httpx.{Client,AsyncClient}"),
    ("clients", "py.httpx.client", "python", "client", "result"),
    ("clients", "py.httpx.client", "python", "configure.keyword", "base_url"),
    ("clients", "py.aiohttp.session", "python", "calls", "aiohttp.ClientSession"),
    ("clients", "py.aiohttp.session", "python", "client", "result"),
    ("clients", "py.aiohttp.session", "python", "configure.keyword", "base_url"),
    ("clients", "py.aiohttp.session", "python", "configure.arg", "0"),
    ("configuration", "cs.configuration", "csharp", "objects", "**.{Configuration,IConfiguration,IConfigurationRoot,IConfigurationManager,ConfigurationManager}"),
    ("configuration", "cs.configuration", "csharp", "calls", "**.{Configuration,IConfiguration,IConfigurationRoot,IConfigurationManager,ConfigurationManager}.GetValue"),
    ("configuration", "cs.configuration", "csharp", "connection_strings", "**.{Configuration,IConfiguration,IConfigurationRoot,IConfigurationManager,ConfigurationManager}.GetConnectionString"),
    ("configuration", "cs.configuration", "csharp", "services_section", "services"),
    ("environment", "cs.aspire.environment", "csharp", "calls", "**.WithEnvironment"),
    ("environment", "cs.aspire.environment", "csharp", "name_arg", "0"),
    ("environment", "cs.aspire.environment", "csharp", "value_arg", "1"),
    ("environment", "cs.aspire.environment", "csharp", "endpoints", "**.GetEndpoint"),
    ("default_data_subjects", "default_data_subjects", None, "values", "customer"),
    ("by_class", "analytics", None, "data_use", "analytics.reporting"),
    ("by_class", "error_tracking", None, "data_use", "essential.service.operations"),
    ("by_class", "messaging", None, "data_use", "essential.service.notifications"),
    ("by_class", "llm", None, "data_use", "essential.service"),
    ("by_class", "http", None, "data_use", "third_party_sharing"),
    ("by_class", "third_party", None, "data_use", "essential.service"),
    ("by_class", "browser_storage", None, "data_use", "functional.storage"),
    ("by_class", "device_storage", None, "data_use", "functional.storage"),
    ("by_processor", "SendGrid", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "Mailgun", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "Postmark", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "Resend", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "Amazon SES", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "MailerSend", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "Mailjet", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "Mailchimp Transactional", None, "data_use", "essential.service.notifications.email"),
    ("by_processor", "Brevo", None, "data_use", "marketing.communications"),
    ("by_processor", "Customer.io", None, "data_use", "marketing.communications"),
    ("by_processor", "Loops", None, "data_use", "marketing.communications"),
    ("by_processor", "Twilio", None, "data_use", "essential.service.notifications.sms"),
    ("by_processor", "Vonage", None, "data_use", "essential.service.notifications.sms"),
    ("by_processor", "Slack", None, "data_use", "essential.service.operations"),
    ("by_processor", "Telegram", None, "data_use", "essential.service.operations"),
    ("by_processor", "Amazon SQS", None, "data_use", "essential.service"),
    ("by_processor", "Azure Service Bus", None, "data_use", "essential.service"),
    ("by_processor", "Azure Event Hubs", None, "data_use", "essential.service"),
    ("by_processor", "Intercom", None, "data_use", "essential.service.operations.support"),
    ("by_processor", "HubSpot", None, "data_use", "marketing.communications"),
    ("by_processor", "Stripe", None, "data_use", "essential.service.payment_processing"),
    ("by_processor", "Polar", None, "data_use", "essential.service.payment_processing"),
    ("by_processor", "Inngest", None, "data_use", "essential.service.operations"),
    ("by_processor", "Trigger.dev", None, "data_use", "essential.service.operations"),
    ("evidence", "datasets", None, "data_use", "essential.service"),
    ("evidence", "user_ingress", None, "data_use", "essential.service"),
    ("evidence", "internal", None, "data_use", "essential.service"),
    ("evidence", "unresolved", None, "data_use", "essential.service"),
)
